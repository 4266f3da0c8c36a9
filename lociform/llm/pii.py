"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans. For each span four labelers vote yes, no or nothing: the shape
of the match, a gazetteer (``gazetteer``: entries by kind), the words before it that speak
for it, and the words before it that speak against it. Expectation-maximisation over the
counts of vote patterns, gathered from all rows, estimates for each kind how reliable each
labeler is; matches of the base kinds have passed their checks and count as true. The
posteriors train a logistic span classifier on the votes and on features that no labeler
sees: length, share of digits, and what stands directly before the span. Spans of the base
kinds always stay; spans of the other kinds stay if the classifier accepts them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import checkpointed, table


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without this holds no valid match, so that the pattern isn't run.
    needs: str
    shape: str
    #: What the gazetteer is asked for: all matches of this in the lower-cased span.
    keys: str
    cue: str
    base: bool = False


#: Possessive forms of the patterns asked for: they match the same strings without recursion or rescans.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"^[A-Za-z0-9][^@]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,}$", r"[a-z]+$", r"e-?mail|contact|write|correo|courriel|kontakt", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$", r"^[0-9]+", r"\bip\b|host|server|address|client", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", r"^(?:4|6|[235][0-9])", r"card|visa|credit|tarjeta|karte|carte", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"^\+[0-9]{1,3}[ .-]?\(?[0-9]", r"^\+(?:1|7|[2-9][0-9])", r"phone|tel|call|mobile|fax", True),
    Kind("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9_-]{20}", r"^(?:(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|[A-Z0-9]{20}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9_-]{24,})$", r"^(?:[a-z]+[_-]|a[a-z]{3})", r"token|secret|api.?key|passw|bearer|credential"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^[0-7]", r"\bssn|social security|tax id"),
    Kind("local_phone", r"(?<![0-9+().-])(?<!\+[0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])", r"[0-9][-.\x20][0-9]{4}", r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$", r"^\(?[2-9]", r"phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", r"^[A-Z]{2}[0-9]{2}", r"^[a-z]{2}", r"iban|account|konto|compte|cuenta"),
    Kind("person", r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}[\p{L}'-]+(?:\x20\p{Lu}[\p{L}'-]+)?", r"(?:Mr|Mrs|Ms|Dr|Prof)\.? ", r"\p{Lu}\p{Ll}+$", r"[\p{L}'-]+", r"name|dear|signed|sincerely|by"),
)
#: Entries by kind, in lower case; more can be given as a table (kind, entry).
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "de", "fr", "es", "it", "uk", "eu", "io"),
    "ip": ("10", "127", "172", "192"),
    "card": ("4", "6", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37"),
    "phone": ("+1", "+7", *(f"+{n}" for n in range(20, 100))),
    "secret": ("akia", "asia", "aiza", "ghp_", "gho_", "ghs_", "ghr_", "sk-", "xoxb-", "xoxp-", "glpat-"),
    "ssn": tuple("01234567"),
    "local_phone": tuple(f"{p}{n}" for p in ("", "(") for n in range(2, 10)),
    "iban": ("de", "fr", "es", "it", "nl", "be", "gb", "at", "ch", "pt", "ie", "pl", "se", "dk", "fi", "no"),
    "person": ("james", "mary", "john", "maria", "anna", "peter", "paul", "laura", "jean", "juan", "hans", "marie", "smith", "jones", "garcia", "müller", "martin", "lopez", "schmidt", "dubois", "david", "sarah", "lee", "brown"),
}
#: As many entries are put into the plan at most; a larger gazetteer is refused.
ENTRIES = 100_000
AGAINST = r"(version|page|isbn|order|invoice|figure|section|sha|md5|commit|checksum|uuid|example)\W{0,3}$"
BEFORE = 24
VOTES = ("shape", "known", "cue", "against")
#: What the classifier sees beside the votes.
MORE = ("size", "lead", "digits")


def gazetteer_of(entries: DataFrame | None) -> dict[str, list[str]]:
    """The built-in gazetteer, and the rows of a table (kind, entry), lower-cased; null rows are left out."""
    found = {k: set(v) for k, v in GAZETTEER.items()}
    if entries is not None:
        rows = entries.select("kind", F.lower("entry").alias("entry")).where("kind IS NOT NULL AND entry IS NOT NULL").distinct().limit(ENTRIES + 1).collect()
        if len(rows) > ENTRIES:
            raise ValueError(f"a gazetteer holds at most {ENTRIES} entries")
        for r in rows:
            found.setdefault(r["kind"], set()).add(r["entry"])
    return {k: sorted(v) for k, v in found.items()}


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: digits.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: Kind, hit: Column) -> Column:
    """The check that a match of a base kind has to pass."""
    n = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if kind.name == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind.name == "card":
        return F.when(n.between(16, 19), _luhn(hit)).otherwise(False)
    if kind.name == "phone":
        return n.between(8, 15)
    return F.lit(True)


def matches(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches that pass; code points, end exclusive."""
    none = F.lit(None).cast("array<struct<start:int,end:int,hit:string>>")
    empty = F.coalesce(none, F.array().cast("array<struct<start:int,end:int,hit:string>>"))
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    steps = F.zip_with(F.split(text, kind.pattern, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        ok = x["hit"].isNotNull() & _passes(kind, x["hit"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    needed = F.instr(text, kind.needs) > 0 if kind.needs == "@" else text.rlike(kind.needs)
    return F.when(needed, F.aggregate(steps, start, step, lambda acc: acc["found"])).otherwise(empty)


def candidates(text: Column, gazetteer: dict[str, list[str]] | None = None) -> Column:
    """Every span with its kind, votes (1, 0, -1) and features, in the order of the kinds, then by start."""
    known = gazetteer_of(None) if gazetteer is None else gazetteer

    def voted(kind: Kind) -> Column:
        def one(s: Column) -> Column:
            first = F.greatest(s["start"] - BEFORE, F.lit(0))
            before = F.lower(F.substring(text, first + 1, s["start"] - first))
            vote = lambda yes, no: F.when(yes, 1).otherwise(no)
            keys = F.regexp_extract_all(F.lower(s["hit"]), F.lit(kind.keys), F.lit(0))
            share = F.length(F.regexp_replace(s["hit"], "[^0-9]", "")) / F.length(s["hit"])
            return F.struct(
                F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                vote(s["hit"].rlike(kind.shape), -1).alias("shape"), vote(F.exists(keys, lambda k: k.isin(known.get(kind.name, []))), 0).alias("known"),
                vote(before.rlike(kind.cue), 0).alias("cue"), F.when(before.rlike(AGAINST), -1).otherwise(0).alias("against"),
                F.least(F.floor((s["end"] - s["start"]) / 12).cast("int"), F.lit(4)).alias("size"),
                F.when(before.rlike(r"[=:]\s*[\"'`]?$"), 2).when(before.rlike(r"[\"'`(<\[]$"), 1).otherwise(0).alias("lead"), F.least(F.floor(share * 4), F.lit(3)).cast("int").alias("digits"),
            )

        return F.transform(matches(text, kind), one)

    return F.concat(*map(voted, KINDS))


def _chance(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: Assumed chance of each vote of a labeler on a span that is not and on one that is personal data.
ASSUMED = {
    "shape": {1: (0.5, 0.8), -1: (0.5, 0.2)},
    "known": {1: (0.1, 0.5), 0: (0.9, 0.5)},
    "cue": {1: (0.1, 0.5), 0: (0.9, 0.5)},
    "against": {-1: (0.4, 0.05), 0: (0.6, 0.95)},
}
#: The assumption weighs as much as this share of a kind's spans, and at least as ``LEAST`` spans.
BELIEF, LEAST = 0.05, 4.0


def reliabilities(patterns: list[tuple], rounds: int = 40) -> list[float]:
    """Posterior that a span of each vote pattern is personal data, by expectation-maximisation.

    ``patterns``: (kind, vote, ..., features, count). Each kind has a prior of its own and,
    for each labeler, its own chances of the votes given the truth, which the assumed ones
    anchor; labelers are taken as independent given the truth. Spans of the base kinds are true.
    """
    base = {k.name for k in KINDS if k.base}
    votes = list(enumerate(VOTES, 1))
    own: dict = defaultdict(int)
    for p in patterns:
        own[p[0]] += p[-1]

    def chances(said: dict, sides: dict, kind: str, k: int, name: str, vote: int) -> float:
        """Log of how much likelier the vote is on a true span."""
        weight, logs = BELIEF * own[kind] + LEAST, []
        for side in (0, 1):
            logs.append(math.log((said[kind, k, vote][side] + weight * ASSUMED[name].get(vote, (0.01, 0.01))[side]) / (sides[kind][side] + weight)))
        return logs[1] - logs[0]

    def posterior(said: dict, sides: dict) -> list[float]:
        out = []
        for p in patterns:
            no, yes = sides[p[0]]
            out.append(1.0 if p[0] in base else _chance(math.log((yes + 1) / (no + 1)) + sum(chances(said, sides, p[0], k, name, p[k]) for k, name in votes)))
        return out

    nothing = defaultdict(lambda: [0.0, 0.0])
    post = posterior(nothing, nothing)
    for _ in range(rounds):
        sides: dict = defaultdict(lambda: [0.0, 0.0])
        said: dict = defaultdict(lambda: [0.0, 0.0])
        for p, q in zip(patterns, post, strict=True):
            for side, share in ((0, 1 - q), (1, q)):
                sides[p[0]][side] += p[-1] * share
                for k, _ in votes:
                    said[p[0], k, p[k]][side] += p[-1] * share
        post = posterior(said, sides)
    return post


def features(pattern: tuple) -> list[str]:
    """Names of what is true of a pattern: its kind, and each vote and feature alone and with the kind."""
    kind, own = pattern[0], list(zip((*VOTES, *MORE), pattern[1:], strict=False))
    return [kind, *(f"{kind}:{n}:{v}" for n, v in own), *(f"{n}:{v}" for n, v in own)]


def classifier(patterns: list[tuple], post: list[float], rounds: int = 300) -> dict[str, float]:
    """Weights of a logistic span classifier by feature, trained on the posteriors; each kind weighs the same."""
    feats = [features(p) for p in patterns]
    total: dict = defaultdict(int)
    for p in patterns:
        total[p[0]] += p[-1]
    w: dict[str, float] = defaultdict(float)
    for _ in range(rounds):
        grad: dict[str, float] = defaultdict(float)
        for f, p, q in zip(feats, patterns, post, strict=True):
            miss = (q - _chance(sum(w[x] for x in f))) * math.sqrt(p[-1] / total[p[0]])
            for x in f:
                grad[x] += miss
        for x, g in grad.items():
            w[x] += 0.3 * (g - 0.002 * w[x])
    return dict(w)


def train(texts: DataFrame, text_col: str, gazetteer: dict[str, list[str]] | None = None) -> dict[str, float]:
    """Weights from the vote patterns of all rows of texts."""
    return trained(texts.select(candidates(F.coalesce(F.col(text_col), F.lit("")), gazetteer).alias("s")), "s")


def trained(rows: DataFrame, column: str) -> dict[str, float]:
    """Weights from arrays of candidates; kinds * 36 votes * 60 values of features reach the driver at most."""
    names = ("kind", *VOTES, *MORE)
    spans = rows.select(F.explode(column).alias("s")).select(*(f"s.{n}" for n in names))
    patterns = sorted(tuple(r) for r in spans.groupBy(*names).count().collect())
    return classifier(patterns, reliabilities(patterns))


def accepted(all_: Column, weights: dict[str, float]) -> Column:
    """array<struct<kind, start, end, base>>: base spans, and accepted spans that touch no base span."""
    base_names = [k.name for k in KINDS if k.base]
    known = F.create_map(*(F.lit(x) for item in sorted(weights.items()) for x in item)) if weights else None

    def weight(name: Column) -> Column:
        return F.lit(0.0) if known is None else F.coalesce(F.element_at(known, name), F.lit(0.0))

    def logit(s: Column) -> Column:
        own = [F.concat_ws(":", F.lit(n), s[n].cast("string")) for n in (*VOTES, *MORE)]
        return sum((weight(x) + weight(F.concat_ws(":", s["kind"], x)) for x in own), weight(s["kind"]))

    def final(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["kind"].isin(base_names))
        more = F.filter(spans, lambda s: ~s["kind"].isin(base_names) & (logit(s) >= 0) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.transform(F.concat(base, more), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].isin(base_names).alias("base")))

    # one-element array: the candidates are computed once
    return F.element_at(F.transform(F.array(all_), final), 1)


def spans_of(text: Column, weights: dict[str, float], gazetteer: dict[str, list[str]] | None = None) -> Column:
    """The accepted spans of a text."""
    return accepted(candidates(text, gazetteer), weights)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(doc_id, found) with found: array<struct<kind, start, end, base>> of the whole text.

    ``entries`` (kind, entry) adds to the gazetteer. A null text counts as empty and has
    none. Null ids and repeated rows are kept; other columns are not read; an empty table
    gives no rows. The candidates are written once: learning and deciding read them, not
    the texts.
    """
    known = gazetteer_of(entries)
    seen = docs.select(F.col(id_col).alias("doc_id"), candidates(F.coalesce(F.col(text_col), F.lit("")), known).alias("spans"))
    if weights is None:
        seen = checkpointed(seen)
        weights = trained(seen, "spans")
    return seen.select("doc_id", accepted(F.col("spans"), weights).alias("found"))


def redact(docs: DataFrame, text_col: str = "text", weights: dict | None = None, entries: DataFrame | None = None) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in angle brackets; a null text stays null.

    Where spans overlap, the one that starts first is replaced. Other columns stay.
    """
    known = gazetteer_of(entries)
    weights = train(docs, text_col, known) if weights is None else weights
    text = F.col(text_col)
    found = F.array_sort(F.transform(spans_of(text, weights, known), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))
    masked = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return docs.withColumn(text_col, F.when(text.isNotNull(), masked))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and positions of the base kinds, and all spans, of every whole text."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(line(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
