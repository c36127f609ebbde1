"""python -m engramql.llm.pii_training: trains the weights of ``pii`` and writes them beside it.

The labelled rows are ``ROWS`` short texts from the grammar below, a bounded
sample by construction: everyday sentences of four languages that carry
mentions of every kind, and sentences with look-alikes that are none.  The
grammar was written by itself, from common names, streets and phrases; nothing
of it comes from the tables that the operator is tested on.  Each row is
written over a name table of its own that lacks ``MISSING`` of the words.  In
half of the rows the features of single context words are left out, so that
the weights do not hang on the grammar's wording.

Training maximises the likelihood of the labelled segmentation among all
segmentations of the candidates (forward and backward over the lattice, with
the transitions between neighbouring segments) by AdaGrad and a small L2 pull.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import defaultdict

from engramql.llm.pii import KINDS, WEIGHTS, Finder, Lexicon, Segment, follows, letters_and_digits, segments

ROWS, EPOCHS, SEED = 9000, 5, 11
#: Share of the names that a row's table lacks.
MISSING = 0.5

GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Susan Jessica Thomas Sarah Karen Daniel Lisa Matthew Nancy Betty Sandra Ashley Steven
Kimberly Andrew Emily Joshua Donna Kevin Brian George Amanda Melissa Hans Klaus Jürgen Stefan Uwe Heike Ute Sabine Petra Katrin Lukas Jonas Anke Günther Pierre Jean Luc Camille Chloé Élodie Hélène
Aurélie Margaux Antoine Olivier José Luis Carmen Pilar Javier Lucía Sofía Álvaro Ramón Inés Priya Anjali Rahul Wei Mei Yuki Haruto Fatima Omar Aisha Olga Dmitri Ingrid Bjørn Zofia Siobhan Lars""".split()
FAMILY = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson
Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Krüger Dubois Moreau Laurent Lefèvre
Girard Fournier Lambert Rousseau Fernández Sánchez Ramírez Torres Domínguez Vázquez Romero Iglesias Patel Sharma Gupta Chen Wang Tanaka Suzuki Haddad Mansour Ivanova Petrov Johansson Nyström Kowalski O'Brien McCarthy""".split()
ENDS = ["a", "o", "in", "er", "en", "ie", "el", "is", "an", "ov", "son", "sen", "mann", "berg", "feld", "ton", "ez", "ard", "ette", "ski"]
STREET = ["Oak", "Pine", "Lincoln", "Washington", "Victoria", "Queens", "Park", "High", "Bridge", "Meadow", "Forest Hill", "Spring", "River", "Chestnut", "Abbey", "Market"]
WAYS = ["Street", "St", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Court", "Way", "Blvd", "Boulevard", "Terrace", "Close", "Place"]
DE = ["Goethestraße", "Schillerstr.", "Lindenallee", "Rosenweg", "Kirchgasse", "Bismarckring", "Königsplatz", "Neue Straße", "Alte Gasse", "Am Markt", "Am Hofgarten", "An der Mühle", "Auf dem Berg", "Im Grund", "Zum Anger", "Rheinufer", "Friedrich-Ebert-Straße"]
FR = ["rue Pasteur", "avenue de la République", "boulevard du Temple", "place des Lilas", "chemin de Halage", "rue des Écoles", "quai de Seine", "impasse des Tilleuls", "allée du Bois", "cours Mirabeau"]
ES = ["Calle de Alcalá", "Avenida de América", "Paseo de Gracia", "Plaza del Sol", "Calle Serrano", "Camino de los Olivos", "Ronda de Toledo", "Avenida Diagonal", "Calle de las Flores"]
HOSTS = ["acme.com", "post.acme.org", "uni.edu", "firma.de", "exemple.fr", "correo.es", "mail.co.uk", "startup.io", "bedrift.no", "firma.pl", "bolag.se", "loja.com.br", "kaisha.jp", "shop.ca", "team.dev", "atelier.be"]
WORDS = "server parser ledger gateway cluster schema worker router session cursor batch index bucket queue widget panel".split()
THINGS = ["Blue Heron", "Silver Falcon", "Red Maple", "Grand Canyon", "New York", "San Diego", "Los Angeles", "Hong Kong", "Visual Studio", "Black Friday", "Google Drive", "Green Ledger", "Morning Star", "Iron Bridge", "North Gate", "Open Source", "Data Science", "Quarterly Report", "Release Notes", "Steering Committee"]


#: Carriers of names are also made by rule: what is done to a person, what a person does, what a person is.
DONE_TO = "hired fired trained praised blamed visited phoned mailed paged promoted elected invited interviewed helped warned replaced greeted escorted tutored nominated".split()
DOES = "painted repaired opened closed cleaned drafted translated carried measured counted tested missed ordered cooked sold bought printed rented parked watered".split()
ROLES = "Editor Driver Teacher Nurse Captain Manager Landlord Witness Client Buyer Seller Singer Chair Judge Pilot Tenant Coach Translator Cashier Gardener".split()


class Grammar:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given, self.family = list(GIVEN), list(FAMILY)

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def pick(self, *xs):
        return self.r.choice(xs)

    def table(self) -> Lexicon:
        """A name table: a part of the names of the grammar."""
        keep = lambda xs: {w.lower() for w in xs if self.r.random() >= MISSING}
        return Lexicon.from_parts(keep(self.given), keep(self.family))

    def coin(self) -> None:
        """Names of the coming rows: common ones and as many of made-up spelling, from beginnings and ends of a few words each."""
        heads = ["".join(self.r.choice(x) for x in ("BDFGHJKLMNPRSTVW", "aeiou", "lmnrstd", ("", "", "a", "i", "o"))) for _ in range(36)]
        made = lambda: [h + e for h in heads for e in self.r.sample(ENDS, 3)]
        self.given, self.family = [*GIVEN, *made()], [*FAMILY, *made()]

    def full(self) -> str:
        g, f = self.r.choice(self.given), self.r.choice(self.family)
        if self.r.random() < 0.08:
            f += "-" + self.r.choice(self.family)
        kind = self.r.random()
        gap = "  " if self.r.random() < 0.06 else " "
        out = f"{f}, {g}" if kind < 0.15 else f"{g} {self.r.choice('ABCDEFGHJKLMNPRSTVW')}. {f}" if kind < 0.26 else f"{g}{gap}{f}"
        case = self.r.random()
        return out.upper() if case < 0.08 else out.lower() if case < 0.16 else out

    def email(self) -> str:
        ascii_ = lambda x: re.sub(r"[^a-z]", "", x.lower()) or "x"
        g, f, h = ascii_(self.r.choice(self.given)), ascii_(self.r.choice(self.family)), self.r.choice(HOSTS)
        local = self.pick(f"{g}.{f}", f"{g[0]}{f}", f"{g}_{f}{self.d(2)}", f"{g}+{self.pick('lists', 'shop', 'dev')}", f"{g}-{f}", self.pick("info", "support", "kontakt", "sales"), f.title())
        form = self.r.random()
        if form < 0.13:
            return f"{local} at {h.replace('.', ' dot ')}"
        if form < 0.24:
            return f"{local} (at) {h.replace('.', ' (dot) ')}"
        if form < 0.35:
            return f"{local}[at]{h.replace('.', '[dot]')}"
        return f"{local}@{h}".upper() if form < 0.4 else f"{local}@{h}"

    def phone(self) -> str:
        d = self.d
        return self.pick(
            f"+1 {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1{d(10)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"07{d(3)} {d(6)}",
            f"+49 89 {d(5)} {d(3)}", f"0049 (0)40 {d(5)}-{d(3)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+353 1 {d(3)} {d(4)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"0{d(3)} {d(6)}", f"089/{d(7)}", f"+43 1 {d(3)}-{d(4)}",
        )

    def ident(self) -> tuple[str, str]:
        """(label, number); the label is no part of the mention."""
        d, r = self.d, self.r
        kind = r.random()
        if kind < 0.12:
            return "", f"{d(3)}-{d(2)}-{d(4)}"
        if kind < 0.42:
            return self.pick("SSN ", "SSN: ", "SSN is ", "social security number ", "social security no. ", "Social Security: "), self.pick(f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}")
        if kind < 0.58:
            return self.pick("passport ", "passport no. ", "Passport number: ", "Reisepass ", "pasaporte "), r.choice("ABCEGHKLNPRXZ") + d(8)
        if kind < 0.72:
            return self.pick("Steuer-ID ", "Steuer-ID: ", "tax id ", "Tax ID: "), f"{d(2)} {d(3)} {d(3)} {d(3)}"
        if kind < 0.86:
            return self.pick("personal number ", "national id ", "national id: ", "Personnummer "), f"{d(6)}-{d(4)}"
        return self.pick("DNI ", "DNI: ", "NIF ", "NIE: "), self.pick(d(8) + self.pick("", "-") + r.choice("ABCDEFGHJKLMNPQRSTVWXYZ"), "X" + d(7) + r.choice("ABCDFGH"))

    def address(self) -> str:
        n, r = str(self.r.randint(1, 320)), self.r
        form = r.random()
        if form < 0.45:
            unit = self.pick("", "", "", f", Apt {r.randint(1, 60)}", f" Apt. {r.randint(1, 60)}", f", Unit {r.randint(1, 12)}", f", Suite {r.randint(1, 40)}", f" #{r.randint(1, 30)}")
            return f"{n} {self.pick('', '', '', 'N. ', 'W ')}{r.choice(STREET)} {r.choice(WAYS)}{unit}"
        if form < 0.65:
            return f"{r.choice(DE)} {n}{self.pick('', '', '', 'a', 'b', 'c')}"
        if form < 0.83:
            return f"{n}{self.pick('', '', '', ' bis', ' ter')}{self.pick('', ',')} {r.choice(FR)}"
        return f"{r.choice(ES)}{self.pick('', ',')} {n}"

    def nothing(self) -> str:
        """A sentence without a mention that has look-alikes."""
        d, r = self.d, self.r
        w, v, t, u, g = r.choice(WORDS), r.choice(WORDS), r.choice(THINGS), r.choice(THINGS), r.choice(self.given)
        return self.pick(
            f"The {t} {w} ships after the {u} one.", f"Our {t} shares a {w} with the {u}.", f"the {t} was closed", f"Das {t} {w} ist weg, die {u} auch.", f"We flew via {t} to {u}.", f"It runs on {t}.", f"in {t} there is a {w}", f"La {t} y el {u} cierran.", f"Le {t} est fermé.", f"Upgrade {w} to {d(1)}.{d(2)}.{d(1)} by {d(4)}-0{r.randint(1, 9)}-1{d(1)}.", f"commit {d(3)}a{d(3)}f{d(2)} touches {w}/{v}.py line {d(4)}", f"Order {d(8)} left on 2024-1{r.randint(0, 2)}-2{d(1)}.",
            f"Ticket ABC-{d(5)} blocks XY-{d(3)}.", f"uuid {d(8)}-{d(4)}-4{d(3)}-8{d(3)}-{d(12)} was reused", f"{w} took {d(4)} ms over {d(2)} retries, {d(3)} of {d(4)} failed", f"host 192.168.{d(2)}.{d(2)} port {d(4)} is closed", f"epoch {d(13)} or {d(10)} in the log",
            f"Ask {g} whether the {w} is free.", f"{g} likes the {w}.", f"{g} and {r.choice(self.given)} met at the {t}.", f"thanks @{w}, see #{v}", f"use root@localhost on the {w} box", f"npm i @{w}/{v}@{d(1)}.{d(1)}.{d(1)}", f"Invoice {d(4)}-{d(4)}-{d(2)} over {d(4)}.{d(2)} EUR", f"ratio {d(1)}-{d(2)}-{d(1)}, seed {d(6)}",
            f"Am Freitag um {r.randint(8, 18)} Uhr läuft der {w.title()} im Keller.", f"Der {w.title()} Dienst hat {d(4)} Zeilen.", f"Le {w} garde {d(4)} lignes, voir {t}.", f"El {w} pierde {d(3)} filas cada hora.", f"Kapitel {d(1)} im {t} Handbuch", f"Nothing in {t} changes the {w}.", f"[REDACTED:{r.choice(KINDS)}] was here", f"size={d(6)} sha={d(5)}b{d(6)}c{d(3)}",
            f"Meet in room {d(3)} on the way to {t}.", f"drive {d(2)} in place {d(1)} of row {d(3)}", f"The court closed case {d(2)}-{d(4)}.", f"{t} Update: {u}", f"HTTP {d(3)} ERROR in {w.upper()} {v.upper()}", f"it stays at {w}.{v} for now", f"look at {w}.{v} at line {d(3)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            f"Every {w} waits for its {v}, which is slow on {t}.", f"am Ende {d(3)} Fehler, im Mittel {d(2)} Zeilen", f"am {w} {d(3)} gemessen", f"zum Teil {d(2)}, in der Regel {d(3)} Treffer",
            f"{r.choice(self.family)} approved it.", f"Prices fell {d(2)} percent to {d(4)} {d(3)} units.", f"skip {d(7)} and {r.choice('abcdef')}{d(7)}", f"part no {d(6)}-{d(3)} rev {r.choice('ABC')}{d(6)}", f"Monday, Tuesday and March, April are off.", f"Product Owner, Tech Lead and {w.title()} Team join.",
            f"build {r.choice('abcdef')}{d(6)} in {w}", f"{w} ({r.choice('abcdef')}{d(6)}) was skipped", f"merged into {w} ({d(7)})", f"rev ({d(7)}) of {v}", f"{d(3)} ok, {d(2)} bad ({d(7)})", f"size={d(4)} {d(4)}", f"total {d(4)} {d(4)} for {w}", f"see {d(8)}{r.choice('abcdef')} in the history", f"ran {d(3)} {d(2)} {d(4)} times",
        )

    def something(self) -> tuple[str, list[tuple[str, str]]]:
        n, n2, m, p, q, a = self.full(), self.full(), self.email(), self.phone(), self.phone(), self.address()
        label, i = self.ident()
        N, M, P, A, I = ("NAME", n), ("EMAIL", m), ("PHONE", p), ("ADDRESS", a), ("ID_NUMBER", i)  # noqa: E741, N806
        t = self.pick("", "", "", "Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Mme ", "Sr. ")
        ext = self.pick("", "", "", " ext. " + self.d(3), ", ext " + self.d(2), " x" + self.d(3))
        lower = self.r.choice(WORDS)
        return self.pick(
            (f"My name is {n} and my number is {p}.", [N, P]), (f"{t}{n} called about the {lower}; reply to {m}.", [N, M]), (f"Please forward this to {m}.", [M]), (f"{m} bounced twice", [M]), (f"Write to {m} instead of {self.r.choice(WORDS)}.", [M]),
            (f"Contact: {n}, {p}{ext}, {m}", [N, P, M]), (f"Tel.: {p}{ext}", [P]), (f"Fax {p}, phone {q}", [P, ("PHONE", q)]), (f"You can text {p} after six.", [P]), (f"({p}) works too", [P]), (f"Call back {p}!", [P]), (f"phone={p}", [P]), (f"{p} is the office, {q} the cell", [P, ("PHONE", q)]),
            (f"The flat at {a} is empty.", [A]), (f"Deliver it to {a}.", [A]), (f"We moved from {a} last May.", [A]), (f"Adresse: {a}", [A]), (f"Der Eingang ist {a}, Klingel links.", [A]), (f"Ort ist {a}.", [A]), (f"Wohnhaft {a}", [A]), (f"Büro {a}, Telefon {p}", [A, P]), (f"location is {a}, ask at the desk", [A]), (f"Wir treffen uns in der Nähe: {a}, bitte pünktlich.", [A]), (f"Rendez-vous au {a} demain.", [A]), (f"Vive en {a}, cerca del mercado.", [A]),
            (f"{label}{i}", [I]), (f"On file: {label}{i}, please check.", [I]), (f"{label}{i} is for {n}.", [I, N]), (f"{n} ({label}{i}) applied.", [N, I]), (f"His {label}{i} expired.", [I]), (f"Bitte {label}{i} eintragen.", [I]),
            (f"Meeting with {n} and {n2} on Friday.", [N, ("NAME", n2)]), (f"{n}, {n2} and the rest agreed.", [N, ("NAME", n2)]) if "," not in n + n2 else (f"{n} agreed.", [N]), (f"Guests: {n}; {n2}", [N, ("NAME", n2)]), (f"{t}{n}'s report mentions {t}{n2}.", [N, ("NAME", n2)]), (f"{n} wrote the {lower} and {n2} reviewed it.", [N, ("NAME", n2)]),
            (f"{n} <{m}> wrote:", [N, M]), (f"signed {n}", [N]), (f"owner: {n}", [N]), (f"Ich habe mit {t}{n} gesprochen.", [N]), (f"Frau {n} ist unter {p} erreichbar.", [N, P]), (f"J'ai vu {t}{n} hier soir.", [N]), (f"Hablé con {n} ayer, su correo es {m}.", [N, M]), (f"{n} lives at {a}.", [N, A]), (f"{n} – {a} – {p}", [N, A, P]), (f"{n}\n{a}\n{p}", [N, A, P]), (f"Regards,\n{n}\n{a}", [N, A]), (f"{n}, {a}", [N, A]), (f"{n}, {a}, {label}{i}", [N, A, I]), (f"form for {n}, {a}, {p}, {m}", [N, A, P, M]), (f"{a}\n{p}", [A, P]), (f"{n}; {a}; {label}{i}", [N, A, I]),
            (f"{n} will bring the {lower}.", [N]), (f"hand the keys to {n}", [N]), (f"Assigned to {n} on Monday.", [N]), (f"reply to {n} today", [N]), (f"Speaker: {n}", [N]), (f"Name: {n}\nBorn: 1980", [N]), (f"Host: {n}, room {self.d(2)}", [N]), (f"{n} has the keys.", [N]), (f"I met {n} at the fair.", [N]), (f"Talk to {n} first.", [N]), (f"Our new colleague is {n}, who starts in June.", [N]), (f"mails from {n} were lost", [N]), (f"Sincerely,\n{n}", [N]), (f"{n} joined us.", [N]), (f"the desk of {n}", [N]), (f"{n} and {n2} left.", [N, ("NAME", n2)]) if "," not in n + n2 else (f"{n} left.", [N]),
            (f"Patient {n}, {label}{i}, {a}", [N, I, A]), (f"To: {n}\nCc: {n2}", [N, ("NAME", n2)]), (f"invite {n} please", [N]), (f"did you tell {n}?", [N]), (f"{n} ({p})", [N, P]), (f"- {n}", [N]), (f"according to {n}, it is done", [N]), (f"hire {n} for the {lower}", [N]),
        )

    def about_a_person(self) -> tuple[str, list[tuple[str, str]]]:
        """A sentence by rule: subject, object or complement is a name."""
        n, w = self.full(), self.r.choice(WORDS)
        did, does, role = self.r.choice(DONE_TO), self.r.choice(DOES), self.r.choice(ROLES)
        low = role.lower()
        return self.pick(
            f"We {did} {n} in {self.pick('May', 'autumn', 'the morning', '2019')}.", f"They {did} {n}", f"{n} {does} the {w}.", f"Yesterday {n} {does} a {w}.", f"The {w} was {does} by {n}.", f"{role}: {n}", f"{role} - {n}", f"our {low} {n} {does} it", f"The {low}, {n}, {does} the {w}.",
            f"a {w} for {n}", f"Nobody but {n} {does} it.", f"Even {n} was {did}.", f"{n} is our {low}.", f"{n} had {does} the {w} before.", f"Was {n} {did}?", f"{n}, {low}", f"As {n} {does} the {w}, we left.", f"between {n} and the {low}", f"without {n} the {w} stops",
        ), [("NAME", n)]

    def by_rule(self) -> str:
        """The same sentences about things."""
        t, w = self.r.choice(THINGS), self.r.choice(WORDS)
        does = self.r.choice(DOES)
        return self.pick(f"We {does} the {t} {w}.", f"The {t} was {does} by the {w}.", f"{t} {w} was {does}.", f"{w.title()}: {t} {self.r.choice(WORDS).title()}", f"Our {t} is {does}.", f"a {w} for the {t}", f"The {w}, the {t}, was {does}.", f"Nobody {does} the {t}.", f"{does.title()} {w.title()} and {t}.")

    def row(self) -> tuple[str, list[tuple[str, str]]]:
        parts, gold = [], []
        for _ in range(self.r.randint(1, 4)):
            if self.r.random() < 0.5:
                parts.append(self.nothing() if self.r.random() < 0.8 else self.by_rule())
            else:
                s, g = self.something() if self.r.random() < 0.75 else self.about_a_person()
                parts.append(s)
                gold += g
        text, case = self.pick(" ", "\n", " ", ". ", "<br>").join(parts), self.r.random()
        if self.r.random() < 0.1:
            text, gold = text.replace("\n", "<br>"), [(k, b.replace("\n", "<br>")) for k, b in gold]
        if case < (0.12 if gold else 0.35) and "ß" not in text:
            change = str.lower if case < 0.04 else str.upper
            return change(text), [(kind, change(body)) for kind, body in gold]
        return text, gold


def gold_path(text: str, gold: list[tuple[str, str]], found: list[Segment]) -> tuple[list[Segment], int]:
    """The candidates that are the labelled mentions, in order, and how many mentions have none."""
    at, path, missed = 0, [], 0
    for kind, body in gold:
        s = text.find(body, at)
        at = s + len(body)
        want = letters_and_digits(body)
        own = [c for c in found if c.kind == kind and c.start >= s - 1 and c.end <= at + 1 and letters_and_digits(text[c.start : c.end]) == want]
        if own:
            path.append(own[0])
        else:
            missed += 1
    return path, missed


def lattice_step(text: str, candidates: list[Segment], gold: list[Segment], weights: dict[str, float]) -> dict[str, float]:
    """Gradient of the log-likelihood of the labelled segmentation, transitions included."""
    order = sorted(candidates, key=lambda c: (c.end, -c.start))
    n = len(order)
    scores = [sum(weights[f] for f in c.features) for c in order]
    steps: dict[tuple[int, int], str | None] = {(j, i): follows(text, order[j], order[i]) for i in range(n) for j in range(i) if order[j].end <= order[i].start}
    before = defaultdict(list)
    after = defaultdict(list)
    for j, i in steps:
        before[i].append(j)
        after[j].append(i)

    def add(xs):
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    move = lambda j, i: weights[steps[j, i]] if steps[j, i] else 0.0
    forward = [0.0] * n
    for i in range(n):
        forward[i] = scores[i] + add([0.0, *(forward[j] + move(j, i) for j in before[i])])
    backward = [0.0] * n
    for j in range(n - 1, -1, -1):
        backward[j] = add([0.0, *(move(j, i) + scores[i] + backward[i] for i in after[j])])
    total = add([0.0, *forward])
    gradient: dict[str, float] = defaultdict(float)
    for k, c in enumerate(order):
        p = math.exp(forward[k] + backward[k] - total)
        for f in c.features:
            gradient[f] -= p
    for (j, i), f in steps.items():
        if f:
            gradient[f] -= math.exp(forward[j] + move(j, i) + scores[i] + backward[i] - total)
    for c in gold:
        for f in c.features:
            gradient[f] += 1.0
    for a, b in zip(gold, gold[1:]):
        if f := follows(text, a, b):
            gradient[f] += 1.0
    return gradient


#: Features that name a single word beside a segment.
SINGLE_WORD = re.compile(r"\w+\|(?:b1|b2|a1)=[^\W\d_]")


def train(rows: int = ROWS, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.25, pull: float = 2e-5) -> dict[str, float]:
    grammar = Grammar(seed)
    data, seen = [], defaultdict(int)
    for k in range(rows):
        if k % 50 == 0:
            grammar.coin()
            table = grammar.table()
        text, gold = grammar.row()
        found = segments(text, table)
        if found:
            if k % 2:
                for c in found:
                    c.features = [f for f in c.features if not SINGLE_WORD.match(f)]
            data.append((text, found, gold_path(text, gold, found)[0]))
            for c in found:
                for f in c.features:
                    seen[f] += 1
    # a feature must occur several times, else it would only name its row
    for _, found, _ in data:
        for c in found:
            c.features = [f for f in c.features if seen[f] >= 8]
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for text, found, path in data:
            for f, g in lattice_step(text, found, path, weights).items():
                g -= pull * rows * 0.01 * weights[f]
                squares[f] += g * g
                weights[f] += rate * g / math.sqrt(squares[f])
    return {f: round(w, 4) for f, w in sorted(weights.items()) if abs(w) > 1e-3}


def measure(weights: dict[str, float], rows: int = 1500, seed: int = 99) -> dict[str, tuple[float, float]]:
    """kind: (precision, recall) on rows of another seed, over tables and made-up names that training did not have."""
    grammar = Grammar(seed)
    hit, got_n, want_n = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in range(rows):
        if k % 50 == 0:
            grammar.coin()
            finder = Finder(grammar.table(), weights)
        text, gold = grammar.row()
        got = [(s.kind, letters_and_digits(text[s.start : s.end])) for s in finder.find(text)]
        rest = [(kind, letters_and_digits(b)) for kind, b in gold]
        for kind, _ in rest:
            want_n[kind] += 1
        for g in got:
            got_n[g[0]] += 1
            if g in rest:
                rest.remove(g)
                hit[g[0]] += 1
    return {kind: (round(hit[kind] / max(1, got_n[kind]), 4), round(hit[kind] / max(1, want_n[kind]), 4)) for kind in KINDS}


if __name__ == "__main__":
    w = train()
    with open(WEIGHTS, "w", encoding="utf-8") as f:
        json.dump(w, f, ensure_ascii=False, indent=0, sort_keys=True)
    print(len(w), "weights; held-out precision and recall", measure(w))
