"""The memory as one object: add, consolidate, search, ask, surface.

State lies in a snapshot store; every call is a DataFrame plan over the current
versions.  Model calls go through ``seams`` and can be replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramql.config import DEFAULT, Settings
from engramql.functions import scalars as S
from engramql.functions import parsing, seams
from engramql.operators import belief, documents, graph, lifecycle, mutations, provenance, retrieval
from engramql.sources import ingest
from engramql.sources.store import SnapshotStore
from engramql.storage import cut

NODE_SCHEMA = (
    "id string, type string, value string, value_hash string, embedding array<float>, embedded_hash string, origin string, s double, c double, last_access bigint, "
    "prev_value string, prev_ts bigint, pending_contradictions string, tombstoned boolean, training_eligible boolean"
)
EDGE_SCHEMA = "src string, dst string, rel string, w double, last_access bigint, kind string"
EVENT_SCHEMA = "id string, ts bigint, event_type string, node_id string, episode_id string, value string, magnitude double"
NO_ANSWER = "nothing stored on that"


class Memory:
    def __init__(self, spark: SparkSession, root: str, cfg: Settings = DEFAULT, embed=seams.embed, extract=seams.extract, judge=seams.judge_both_ways, compose=seams.compose, triples=seams.triples):
        self.spark, self.cfg = spark, cfg
        self.store = SnapshotStore(spark, root)
        self.embed, self.extract, self.judge, self.compose, self.triples = embed, extract, judge, compose, triples

    def table(self, name: str, schema: str) -> DataFrame:
        found = self.store.read(name)
        return self.spark.createDataFrame([], schema) if found is None else found

    @property
    def episodes(self) -> DataFrame:
        return self.table("episode", ingest.EPISODE)

    @property
    def nodes(self) -> DataFrame:
        return self.table("node", NODE_SCHEMA)

    @property
    def live(self) -> DataFrame:
        return self.nodes.where(~F.coalesce("tombstoned", F.lit(False)))

    @property
    def edges(self) -> DataFrame:
        return self.table("edge", EDGE_SCHEMA)

    @property
    def events(self) -> DataFrame:
        return self.table("event", EVENT_SCHEMA)

    def add(self, records: DataFrame, now_ms: int) -> int:
        """Append records; the number of new ones."""
        stored = self.store.read("episode")
        fresh = ingest.new_rows(ingest.prepare(records, now_ms, self.cfg), stored)
        fresh = cut(fresh, "fresh")
        self.store.append("episode", fresh)
        return fresh.count()

    def _claims(self, episodes: DataFrame) -> DataFrame:
        extract, embed = self.extract, self.embed

        def run(batches):
            import pandas as pd

            for b in batches:
                rows = []
                for r in b.itertuples(index=False):
                    try:
                        rows += [(f"{r.id}:{i}", r.id, c.value, [float(x) for x in embed(c.value)], None) for i, c in enumerate(extract(r.content))]
                    except Exception as e:  # noqa: BLE001 - one bad episode must not stop the pass
                        rows.append((f"{r.id}:error", r.id, None, None, str(e)[:500]))
                yield pd.DataFrame(rows, columns=["id", "episode_id", "value", "embedding", "error"])

        claims = episodes.select("id", "content").mapInPandas(run, "id string, episode_id string, value string, embedding array<float>, error string")
        about = episodes.select(F.col("id").alias("episode_id"), "origin", "role", "session_id", "hard_keep", "salience", "ts")
        return claims.join(about, "episode_id")

    def _triples(self, episodes: DataFrame) -> DataFrame:
        """(subject, predicate, object) that the model reads from episodes, through the validator."""
        triples = self.triples

        def run(batches):
            for b in batches:
                yield b.assign(answer=[triples(t) for t in b["content"]])[["answer"]]

        answers = episodes.select("content").mapInPandas(run, "answer string")
        return answers.select(F.explode(parsing.valid_triples(F.col("answer"))).alias("t")).select("t.subject", "t.predicate", "t.object").distinct()

    def consolidate(self, now_ms: int) -> dict[str, int]:
        """One pass over the open episodes that clear the gate; counts by action."""
        episodes = self.episodes
        waiting = episodes.where(~F.col("consolidated"))
        gate = (F.col("salience") >= S.skip_threshold(F.col("source"), F.col("role"), self.cfg)) | F.col("hard_keep")
        taken = waiting.where((F.col("origin") != "inferred") & gate)
        read = cut(self._claims(taken).withColumn("id", F.sha2("id", 256)), "claims")
        # an episode whose extraction failed stays open and is tried again in the next pass
        failed = read.where("error IS NOT NULL").select(F.col("episode_id").alias("id")).distinct()
        claims = read.where("error IS NULL").drop("error")
        nodes = self.nodes
        live = cut(self.live, "live")
        routes = belief.gated(claims, belief.nominate(claims, live, self.cfg.candidate_k), live, self.cfg)
        decided = routes.withColumn("node_id", F.when(F.col("route") != "unrelated", F.col("node_id"))).join(claims.withColumnRenamed("id", "claim_id").drop("embedding"), "claim_id")
        applied = cut(belief.apply_claims(decided, live, self.cfg, self.judge), "applied")
        last = applied.groupBy("node_id").agg(F.max_by(F.struct("value", "s", "c", "last_access", "prev_value", "pending", "action"), "seq").alias("x"))
        changes = last.select(
            F.col("node_id").alias("id"), F.lit("fact").alias("type"), "x.value", F.lit("observed").alias("origin"), "x.s", "x.c", "x.last_access", F.col("x.pending").alias("pending_contradictions")
        )
        merged = cut(mutations.upsert_nodes(nodes, changes, self.cfg), "merged")
        embed = self.embed
        dirty = merged.where("embedded_hash IS NULL AND trim(value) <> '' AND NOT tombstoned").select("id", "value_hash", "value")

        def vectors(batches):
            for b in batches:
                yield b.assign(vector=[[float(x) for x in embed(v)] for v in b["value"]])[["id", "value_hash", "vector"]]

        self.store.publish("node", mutations.set_embeddings(merged, dirty.mapInPandas(vectors, "id string, value_hash string, vector array<float>")))
        per = applied.join(claims.select(F.col("id").alias("claim_id"), "episode_id", "ts"), "claim_id")
        fresh = per.select(F.sha2(F.concat_ws("|", "claim_id", "action"), 256).alias("id"), "ts", F.col("action").alias("event_type"), "node_id", "episode_id", "value", "magnitude")
        self.store.append("event", fresh.join(self.events.select("id"), "id", "left_anti"))
        grown = decided.where("node_id IS NOT NULL").select("claim_id", F.col("node_id").alias("src")).join(applied.where("action = 'extend'").select("claim_id", F.col("node_id").alias("dst")), "claim_id")
        links = grown.select("src", "dst", F.lit("extends").alias("rel"), F.lit(0.1).alias("w"), F.lit(now_ms).cast("bigint").alias("last_access"), F.lit("relation").alias("kind"))
        # names are resolved against the nodes before this pass, so a triple never binds to what it just added
        typed = lifecycle.triple_edges(self._triples(taken.join(failed, "id", "left_anti")), live, now_ms)
        self.store.publish("edge", mutations.upsert_edges(self.edges, links.unionByName(typed.select(*links.columns))))
        self.store.publish("episode", mutations.mark_consolidated(episodes, waiting.join(failed, "id", "left_anti")))
        return {r.action: r.n for r in applied.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}

    def search(self, text: str, k: int | None = None) -> DataFrame:
        """(id, value, cos): the nearest live nodes above the floor, without stale entities."""
        best = retrieval.top(retrieval.cosine_scores(self.live, self.embed(text[:4000]), "value", "type"), "cos", k or self.cfg.ranked_k)
        stale = provenance.stale_entities(self.events, self.nodes)
        return best.where(F.col("cos") >= self.cfg.ranked_floor).join(stale, "id", "left_anti").select("id", "value", "cos").orderBy(F.desc("cos"), "id")

    def recall(self, text: str) -> DataFrame:
        """(id, value, via): the best match, what lies along the predicate that the text asks for, the schema, its members and related schemas."""
        hit = retrieval.top(retrieval.cosine_scores(self.live, self.embed(text)), "cos", 1).select("id")
        up = self.edges.where("kind = 'abstracts'").join(hit.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).limit(1)
        members = self.edges.where("kind = 'abstracts'").join(up.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).orderBy("id").limit(self.cfg.recall_budget)
        side = graph.fan_out(self.edges, "schema_rel", self.cfg.sideways_budget).join(up, "id", "left_semi").select(F.col("other").alias("id"))
        asked = documents.predicate_of(self.embed(text), documents.gloss_vectors(self.embed), self.cfg.gloss_threshold)
        path = graph.typed_reach(self.edges, hit, [asked], self.cfg.recall_budget).select("id") if asked else hit.where("false")
        parts = [path.withColumn("via", F.lit("along")), hit.withColumn("via", F.lit("match")), up.withColumn("via", F.lit("schema")), members.withColumn("via", F.lit("member")), side.withColumn("via", F.lit("related"))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.join(self.live.select("id", "value"), "id").groupBy("id", "value").agg(F.min("via").alias("via"))

    def ask(self, question: str, now_ms: int) -> str:
        """An answer from ranked lines, else from recall (marked as inferred), else none; it is stored as an inferred episode."""
        query = seams.as_statement(question)
        lines = [r.value for r in self.search(query).limit(self.cfg.ranked_k).collect()]
        answer = self.compose(question, lines) if lines else ""
        if not answer:
            found = [r.value for r in self.recall(query).limit(self.cfg.recall_budget).collect()]
            answer = f"{self.compose(question, found)} (inferred)" if found else NO_ANSWER
        row = self.spark.createDataFrame([(answer, "inferred", "assistant", now_ms)], "content string, origin string, role string, ts bigint")
        self.add(row, now_ms)
        return answer

    def remember(self, text: str, session_id: str, now_ms: int) -> dict[str, int]:
        """State a fact at once, as the user's word: its event by name, or nothing for a value that is there already."""
        claim = self.spark.createDataFrame([(seams.hashlib.sha256(f"{session_id}|{now_ms}|{text}".encode()).hexdigest(), text, [float(x) for x in self.embed(text)])], "id string, value string, embedding array<float>")
        nodes = cut(self.nodes, "nodes")
        live = nodes.where(~F.coalesce("tombstoned", F.lit(False)))
        routes = cut(lifecycle.remembered(claim, live, now_ms, self.cfg), "routes")
        found = routes.first()
        event = {"insert": "unrelated", "append": "contradict_append", "oscillation": "contradict_oscillation", "reconcile": "contradict_reconcile"}.get(found.action)
        if event is None:
            return {}
        new = routes.select(F.col("new_id").alias("id"), F.lit("fact").alias("type"), F.lit(text).alias("value"), F.lit("asserted_by_user").alias("origin"), F.lit(0.9).alias("s"), F.lit(0.95).alias("c"), F.lit(now_ms).cast("bigint").alias("last_access"), "prev_value")
        merged = mutations.upsert_nodes(nodes, new, self.cfg)
        if found.action == "reconcile":
            merged = mutations.tombstone(merged, routes.select(F.col("old_id").alias("id")))
        vector = claim.select(F.lit(found.new_id).alias("id"), F.sha2("value", 256).alias("value_hash"), F.col("embedding").alias("vector"))
        self.store.publish("node", mutations.set_embeddings(merged, vector))
        self.store.append("event", routes.select(F.sha2(F.concat_ws("|", "new_id", F.lit(event)), 256).alias("id"), F.lit(now_ms).cast("bigint").alias("ts"), F.lit(event).alias("event_type"), F.col("new_id").alias("node_id"), F.lit(None).cast("string").alias("episode_id"), F.lit(text).alias("value"), "magnitude"))
        return {event: 1}

    def ambient(self, text: str, k: int = 5, floor: float = 0.45) -> list[str]:
        """Short lines of what a prompt touches, for injection beside it."""
        found = self.search(text, k).where(F.col("cos") >= floor)
        return [r.line for r in documents.ambient_lines(found).collect()]

    def record_snapshot(self, questions: list[str], now_ms: int) -> DataFrame:
        """(id, query, expected): present best matches of questions, to be replayed later."""
        rows = []
        for q in questions:
            hit = retrieval.tri_state(self.nodes, self.embed(q), self.cfg.deleted_similarity).first()
            value = self.nodes.where(F.col("id") == hit.id).first().value if hit.id else None
            rows.append((seams.hashlib.sha256(q.encode()).hexdigest(), q, value, now_ms))
        return self.spark.createDataFrame(rows, "id string, query string, expected string, ts bigint")

    def replay_snapshot(self, recorded: DataFrame) -> DataFrame:
        """(id, similarity, same) of recorded answers against present ones."""
        now = self.record_snapshot([r.query for r in recorded.select("query").collect()], 0)
        return documents.replayed(recorded, now.select("id", F.col("expected").alias("actual")), self.cfg.snapshot_match)

    def surface(self, due: DataFrame, now_ms: int) -> DataFrame:
        return retrieval.surface_rank(due, self.live, now_ms)

    def surface_seen(self, shown: DataFrame, seen: DataFrame) -> DataFrame:
        """Outcomes of shown items merged by (node_id, occurrence_due_at), keeping the first creation time."""
        return mutations.upsert_sidecar(shown, seen, ["node_id", "occurrence_due_at"], once=("created_at",))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and links as JSON lines for export."""
        return self.live.select(F.to_json(F.struct("id", "type", "value", "s", "c")).alias("node")), self.edges.select(F.to_json(F.struct("src", "dst", "rel", "w", "kind")).alias("link"))
