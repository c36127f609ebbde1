"""Ingest, text and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.config import CORRECTIONS, DIRECTIVES
from engramql.functions import parsing as J
from engramql.functions import scalars as S
from engramql.operators.graph import PREDICATES
from engramql.plans import model as M
from engramql.plans.registry import Registry
from engramql.sources import files, ingest
from engramql.storage import table

reg = Registry()


def _alt(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


_WORDS = r"len(list_filter(string_split_regex(coalesce(content, ''), '[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]+'), lambda w: w <> ''))"
_ROLE = "CASE role WHEN 'user' THEN 0.8e0 WHEN 'assistant' THEN 0.6e0 WHEN 'tool' THEN 0.2e0 ELSE 0e0 END"
_SRC = "CASE source WHEN 'claude-code' THEN 1e0 WHEN 'obsidian' THEN 0.9e0 WHEN 'granola' THEN 0.5e0 WHEN 'gmail' THEN 0.35e0 WHEN 'gcal' THEN 0.45e0 ELSE 1e0 END"


@reg.query(
    "salience_gate",
    rf"""WITH m AS (SELECT *, regexp_matches(coalesce(content, ''), '(?i){_alt(DIRECTIVES)}') AS dir, regexp_matches(coalesce(content, ''), '(?i){_alt(CORRECTIONS)}') AS cor FROM episodes)
    SELECT id, round(least(0.3e0 * {_ROLE} + 0.2e0 * least({_WORDS} / 100e0, 1e0) + 0.35e0 * dir::INT + 0.15e0 * cor::INT, 1e0) * {_SRC}, 6) AS salience,
    coalesce(source IN ('claude-code', 'obsidian') AND role = 'user' AND (dir OR cor), false) AS hard_keep FROM m""",
    "episodes",
)
def salience_gate(spark, d):
    """F4, F5, S2."""
    e = M.episodes(spark, d, "content", "role", "source")
    return e.select("id", F.round(S.salience(F.col("content"), F.col("role"), F.col("source")), 6).alias("salience"), S.hard_keep(F.col("content"), F.col("role"), F.col("source")).alias("hard_keep"))


def _redact_sql(c: str) -> str:
    for p, mark in S.SECRETS:
        # RE2 has no lookahead; a secret's value never starts with the marker's bracket here
        p = p.replace(r"(?!\[REDACTED:)\S+", r"[^\s\[]\S*")
        c = f"regexp_replace({c}, '{p}', '{mark}', 'g')"
    return c


@reg.query("redact_secrets", f"SELECT id, {_redact_sql('content')} AS content FROM episodes WHERE content IS NOT NULL", "episodes")
def redact_secrets(spark, d):
    """F6."""
    return M.episodes(spark, d, "content").where("content IS NOT NULL").select("id", S.redact_secrets(F.col("content")).alias("content"))


_SLUG = "lower(regexp_extract(rtrim(trim(coalesce(cwd, '')), '/'), '^/(?:Users|home)/[^/]+(?:/([^/]+))?', 1))"


@reg.query("scope_from_cwd", f"SELECT cwd, CASE WHEN {_SLUG} IN ('', 'resume') THEN 'global' ELSE {_SLUG} END AS scope, count(*) AS n FROM episodes GROUP BY ALL", "episodes")
def scope_from_cwd(spark, d):
    """F7, F9."""
    return M.episodes(spark, d, "cwd").groupBy("cwd", S.cwd_scope(F.col("cwd")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


_NORM = r"regexp_replace(regexp_replace(lower(value), '^[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g'), '[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')"


@reg.query("normalize_value", f"SELECT sha256({_NORM}) AS norm_hash, count(*) AS n, min(id) AS first_id FROM live WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) > 1", "live")
def normalize_value(spark, d):
    """values that are equal once normalised."""
    n = M.live(spark, d, "value").where("value IS NOT NULL")
    return n.groupBy(F.sha2(S.normalize_value(F.col("value")), 256).alias("norm_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@reg.query(
    "node_text_flags",
    rf"""SELECT id, coalesce(value <> '' AND NOT contains(value, '?') AND len(list_filter(string_split_regex(value, '\s+'), lambda w: w <> '')) <= 8 AND NOT ({' OR '.join(f"contains(lower(value), '{p.replace(chr(39), chr(39) * 2)}')" for p in S.REFUSALS)}), false) AS valid_name,
    regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS subject, regexp_matches(value, '{_alt(S.NOISE)}') AS noise, regexp_matches(value, '(?i){_alt(S.POLLUTION)}') AS pollution,
    (trim(value) LIKE '%?' OR lower(regexp_extract(trim(value), '^(\S*)', 1)) IN ({', '.join(f"'{w}'" for w in S.QUESTION_WORDS)})) AS question FROM live WHERE value IS NOT NULL""",
    "live",
)
def node_text_flags(spark, d):
    """F19, F20, F21, F22, F23."""
    v = F.col("value")
    n = M.live(spark, d, "value").where("value IS NOT NULL")
    return n.select("id", S.valid_schema_name(v).alias("valid_name"), S.subject_name(v).alias("subject"), S.is_noise(v).alias("noise"), S.is_pollution(v).alias("pollution"), S.is_interrogative(v).alias("question"))


@reg.query(
    "doc_titles",
    r"""SELECT doc_id, CASE WHEN coalesce(regexp_extract(text, '(?m)^#[ \t]+(.+?)[ \t]*$', 1), '') = '' THEN coalesce(scope, '') ELSE regexp_extract(text, '(?m)^#[ \t]+(.+?)[ \t]*$', 1) END AS title,
    CASE WHEN regexp_matches(coalesce(scope, ''), '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN 'chapter' WHEN contains(coalesce(scope, ''), ':') THEN 'subject' ELSE 'hub' END AS class,
    left(regexp_replace(lower(coalesce(scope, '')), '[^a-z0-9:-]', '', 'g'), 64) AS slug FROM documents WHERE text IS NOT NULL""",
)
def doc_titles(spark, d):
    """F25, F26, F27, F28."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.coalesce("scope", F.lit("")).alias("scope"))
    return t.select("doc_id", S.doc_title(F.col("text"), F.col("scope")).alias("title"), S.slug_class(F.col("scope")).alias("class"), S.clean_slug(F.col("scope")).alias("slug"))


@reg.query(
    "cap_content",
    """WITH l AS (SELECT doc_id, text, strlen(text) - length(text) AS more FROM documents WHERE strlen(text) > 8000), k AS (SELECT doc_id, text, unnest(range(greatest(0, 8000 - more), 8001)) AS n FROM l),
    b AS (SELECT doc_id, max(n) AS n FROM k WHERE strlen(left(text, n)) <= 8000 GROUP BY 1)
    SELECT d.doc_id, CASE WHEN b.n IS NULL THEN d.text ELSE left(d.text, b.n) || CASE WHEN strlen(left(d.text, b.n)) < 8000 THEN chr(65533) ELSE '' END || '…[truncated]' END AS text FROM documents d LEFT JOIN b USING (doc_id)""",
)
def cap_content(spark, d):
    """all documents, capped where they are longer."""
    t = table(spark, d, "documents")
    return t.select("doc_id", S.cap_content(F.col("text")).alias("text"))


_CHUNKS = r"""WITH s AS (SELECT doc_id, CASE WHEN strlen(text) <= 4000 THEN [text] ELSE string_split(regexp_replace(text, '(?m)^(#{1,2} )', chr(1) || '\1', 'g'), chr(1)) END AS parts FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, unnest(list_filter(parts, lambda x: trim(x) <> '')) AS text, generate_subscripts(list_filter(parts, lambda x: trim(x) <> ''), 1) - 1 AS chunk FROM s)
 SELECT doc_id, chunk::INT AS chunk, length(text) AS chars FROM p WHERE trim(text) <> ''"""


@reg.query("chunk_notes", _CHUNKS)
def chunk_notes(spark, d):
    """S5, S9."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return files.note_chunks(t, 4_000).select(F.col("path").alias("doc_id"), "chunk", F.length("text").alias("chars"))


@reg.query(
    "chunk_texts",
    r"""WITH RECURSIVE tk AS (SELECT doc_id, regexp_extract_all(text, '[^\n]{1,999}\n?|\n') AS t FROM documents WHERE text IS NOT NULL AND text <> ''),
    st AS (SELECT doc_id, 1 AS i, 0 AS piece, length(t[1]) AS size FROM tk UNION ALL SELECT s.doc_id, i + 1, CASE WHEN size + length(t[i + 1]) <= 1000 THEN piece ELSE piece + 1 END, CASE WHEN size + length(t[i + 1]) <= 1000 THEN size + length(t[i + 1]) ELSE length(t[i + 1]) END FROM st s JOIN tk USING (doc_id) WHERE i < len(t))
    SELECT s.doc_id, piece, string_agg(t[i], '' ORDER BY i) AS text FROM st s JOIN tk USING (doc_id) GROUP BY 1, 2""",
)
def chunk_texts(spark, d):
    """Pieces of at most 1,000 characters, cut after line ends."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.posexplode(J.text_chunks(F.col("text"), 1_000)).alias("piece", "text"))


@reg.query(
    "speaker_turns",
    r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS n FROM documents WHERE text IS NOT NULL),
    m AS (SELECT *, regexp_extract(raw, '^([A-Z][\w .''-]{0,40}):\s*(.*)$', 1) AS sp, regexp_extract(raw, '^([A-Z][\w .''-]{0,40}):\s*(.*)$', 2) AS rest FROM l),
    t AS (SELECT doc_id, n, sp, trim(CASE WHEN sp <> '' THEN rest ELSE raw END) AS body, sum((sp <> '')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS turn FROM m),
    g AS (SELECT doc_id, turn::BIGINT AS turn, max(sp) AS sp, string_agg(body, chr(10) ORDER BY n) FILTER (body <> '') AS text FROM t GROUP BY 1, 2)
    SELECT doc_id, turn, CASE WHEN sp = '' THEN 'Unknown' ELSE sp END AS speaker, length(text) AS chars FROM g WHERE coalesce(text, '') <> ''""",
)
def speaker_turns(spark, d):
    """S4."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return files.speaker_turns(t.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))).select(F.col("path").alias("doc_id"), "turn", "speaker", F.length("text").alias("chars"))


_PENDING = "SELECT id, unnest(from_json(pending_contradictions, '[{\"episode_id\":\"VARCHAR\",\"session_id\":\"VARCHAR\",\"origin\":\"VARCHAR\"}]')) AS x FROM live WHERE pending_contradictions IS NOT NULL"


@reg.query("pending_provenance", f"WITH p AS ({_PENDING}) SELECT id, count(*) AS pending, count(DISTINCT x.session_id) FILTER (x.origin <> 'inferred') AS sessions FROM p GROUP BY id", "live")
def pending_provenance(spark, d):
    """J7, F17, ST6."""
    p = M.live(spark, d, "pending_contradictions").select("id", J.contradictions(F.col("pending_contradictions")).alias("p"))
    return p.where(F.size("p") > 0).select("id", F.size("p").cast("bigint").alias("pending"), J.distinct_provenance(F.col("p")).cast("bigint").alias("sessions"))


@reg.query(
    "triples_json",
    f"SELECT DISTINCT src AS subject, rel AS predicate, dst AS object FROM edges WHERE rel IN ({', '.join(f'{p!r}' for p in PREDICATES)}) AND src <> dst",
    "edges",
)
def triples_json(spark, d):
    """Edges of a node written as JSON and read back through the validator."""
    part = F.pmod(F.xxhash64("dst"), F.lit(256))  # the edges of a hot node are many answers
    e = M.edges(spark, d).groupBy("src", "rel", part).agg(F.to_json(F.collect_list(F.struct(F.col("src").alias("subject"), F.col("rel").alias("predicate"), F.col("dst").alias("object")))).alias("answer"))
    return e.select(F.explode(J.valid_triples(F.col("answer"))).alias("t")).select("t.subject", "t.predicate", "t.object").distinct()


@reg.query(
    "claims_json",
    """WITH n AS (SELECT left(id, 3) AS batch, value, type, row_number() OVER (PARTITION BY left(id, 3) ORDER BY value, type) AS r, count(*) OVER (PARTITION BY left(id, 3)) AS m FROM live WHERE value IS NOT NULL),
    k AS (SELECT * FROM n WHERE trim(value, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT (ascii(batch) % 2 = 0 AND r = m))
    SELECT batch, (row_number() OVER (PARTITION BY batch ORDER BY r) - 1)::INT AS pos, trim(value, ' ' || chr(9) || chr(10) || chr(13)) AS value, CASE WHEN type IN ('fact', 'entity') THEN type ELSE 'fact' END AS type FROM k""",
    "live",
)
def claims_json(spark, d):
    """Model answers of node values, some cut short."""
    n = M.live(spark, d, "value", "type").where("value IS NOT NULL").groupBy(F.substring("id", 1, 3).alias("batch")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("value", "type")))).alias("answer"))
    cut = F.when(F.ascii("batch") % 2 == 0, F.expr("substring(answer, 1, length(answer) - 7)")).otherwise(F.concat(F.lit("Here: "), "answer"))
    return J.parse_claims(n.select("batch", cut.alias("answer")), "batch", "answer").select("batch", "pos", "claim.value", "claim.type")


@reg.query(
    "idempotent_append",
    "WITH k AS (SELECT source, external_id, min(ts) AS ts FROM episode WHERE external_id IS NOT NULL GROUP BY 1, 2) SELECT source, count(*) AS n FROM (SELECT source FROM k UNION ALL SELECT DISTINCT ON (id) source FROM episode WHERE external_id IS NULL) GROUP BY 1",
)
def idempotent_append(spark, d):
    """S1, ST1: what an append of all rows would store."""
    e = table(spark, d, "episode").select("id", "ts", "source", "external_id")
    return ingest.new_rows(e, None).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@reg.query(
    "calendar_provenance",
    r"""WITH t AS (SELECT raw_id, 'Title · Event: ' || id || CASE WHEN len(recurrence) > 0 THEN ' · RRULE: ' || recurrence[1] ELSE '' END AS content FROM (SELECT DISTINCT ON (raw_id) * FROM raw_calendar_event) WHERE id IS NOT NULL)
    SELECT raw_id, nullif(regexp_extract(content, '·\s*Event:\s*(\S+)', 1), '') AS event_id, nullif(regexp_extract(content, '·\s*RRULE:\s*([^\n·]+)', 1), '') AS rule FROM t""",
)
def calendar_provenance(spark, d):
    """F24."""
    e = table(spark, d, "raw_calendar_event").where("id IS NOT NULL").dropDuplicates(["raw_id"])
    text = F.concat(F.lit("Title · Event: "), F.col("id"), F.when(F.size("recurrence") > 0, F.concat(F.lit(" · RRULE: "), F.element_at("recurrence", 1))).otherwise(""))
    t = e.select("raw_id", text.alias("content"))
    return t.select("raw_id", S.calendar_reference(F.col("content"), F.lit("gcal"), "Event").alias("event_id"), S.calendar_reference(F.col("content"), F.lit("gcal"), "RRULE").alias("rule"))


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
