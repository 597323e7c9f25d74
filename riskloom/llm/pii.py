"""Personal data by weak supervision, in SQL expressions only.

Base spans (email, ip, card, phone) are exact pattern matches. Wider patterns propose further
candidates (spelled-out addresses, national phone numbers, long IP addresses, secrets).
Five labelers vote +1, 0 or -1 on every candidate: the strict pattern, a gazetteer, the words
before it, its shape, and a veto for degenerate values. Expectation maximisation over the
table of vote patterns (at most kinds x 3^5 rows, whatever the corpus) estimates each
labeler's reliability; its posteriors are the soft labels of a naive Bayes span classifier
over bucketed features, which decides on the candidates that no base span covers.

Positions are code points, the end exclusive. Patterns are written so that matching is linear
in the text: a match starts where a run starts or where the last match ended.

Defined results: null or empty text has no spans; base spans always stay and a candidate that
overlaps one is dropped; of overlapping candidates the first stays; repeated rows count as
documents; an empty table gives no rows; with no candidates nothing is learnt; extra columns
are ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.shared import Scope, materialize
from riskloom.llm.native import let

KINDS = ("email", "ip", "card", "phone", "secret")
# ---- fixed values: the base patterns, in possessive form (same matches, no backtracking)
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# ---- wider patterns that only propose
WIDE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{14,}+",
}
#: What a text must hold for a pattern to match anywhere in it.
_DIGIT = "[0-9]"
GATES = {("email", True): "@", ("email", False): r"[\[(]at[\])]", ("ip", False): ":"}
LABELERS = ("pattern", "gazetteer", "context", "shape", "veto")
# ---- gazetteers: fixed values
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "example")
NAMES_BEFORE = r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|bearer)[\x20\"'=:]*$"
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|address|from|to)\b[^.\n]*$",
    "ip": r"(?i)(?:ip|host|server|address|login|from)\b[^.\n]*$",
    "card": r"(?i)(?:card|visa|credit|account|payment)\b[^.\n]*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|number)\b[^.\n]*$",
    "secret": r"[=:]\x20?[\"']?$",
}
AGAINST = r"(?i)(?:version|release|build|isbn|doi|commit|sha\d*)\b[\x20:.]*$"
ROUNDS, SMOOTH, THRESHOLD = 25, 1.0, 0.5


def find_spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places: array of (start, end, value)."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def place(b: Column) -> Column:
        pairs = F.zip_with(b["m"], F.slice(b["gaps"], 1, F.size(b["m"])), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

        def add(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["g"]
            end = start + F.length(p["m"])
            one = F.struct(start.alias("start"), end.alias("end"), p["m"].alias("value"))
            return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

        return F.aggregate(pairs, empty, add, lambda acc: acc["out"])

    return let(both, place)


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.substr(part(x), F.lit(1), F.lit(3))), F.lit("9999")), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def _gazetteer(kind: str, value: Column, before: Column) -> Column:
    if kind == "email":
        last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        return F.when(last.isin(*DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(value.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])\."), -1).otherwise(1)
    if kind == "card":
        return F.when(value.rlike("^[3-6]"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(value.rlike(r"^\+?\(?[1-9]"), 1).otherwise(-1)
    return F.when(before.rlike(NAMES_BEFORE), 1).otherwise(0)


def _candidates_of(kind: str, text: Column, pattern: str, base: bool) -> Column:
    """Candidates of one pattern with votes and features."""

    def judge(s: Column) -> Column:
        value = s["value"]
        before = F.substr(text, F.greatest(s["start"] - 29, F.lit(1)), F.least(s["start"], F.lit(30)))
        after = F.substr(text, s["end"] + 1, F.lit(1))
        digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
        letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        clean = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("[A-Za-z0-9]")
        if kind == "secret":
            strict = F.when(value.rlike("^AKIA[0-9A-Z]{16}$"), 1).otherwise(0)
            shape = F.when((digits >= 3) & (letters >= 3) & ~value.rlike("[/_-]") & (value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-Z]+$") | (digits * 5 >= F.length(value))), 1).otherwise(-1)
            veto = F.when((digits < 2) | value.rlike(r"^(.)\1*$") | value.rlike("[A-Za-z]?[a-z]{11}"), -1).otherwise(0)
        else:
            strict = F.lit(1 if base else 0)
            shape = F.when(clean, 1).otherwise(-1)
            veto = F.when(F.regexp_replace(value, "[^0-9A-Za-z]", "").rlike(r"^(.)\1*$"), -1).otherwise(0)
        context = F.when(before.rlike(AGAINST), -1).when(before.rlike(CONTEXT[kind]), 1).otherwise(0)
        votes = F.array(*[v.cast("int") for v in (strict, _gazetteer(kind, value, before), context, shape, veto)])
        features = F.array(
            F.concat(F.lit("length "), F.least(F.floor(F.length(value) / 4), F.lit(12)).cast("string")),
            F.concat(F.lit("digits "), F.floor(10 * digits / F.greatest(F.length(value), F.lit(1))).cast("string")),
            F.concat(F.lit("before "), F.when(before == "", "edge").when(before.rlike(r"\s$"), "space").when(before.rlike("[A-Za-z0-9]$"), "word").otherwise("mark")),
            F.concat(F.lit("case "), F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), "mixed").when(value.rlike("[A-Z]"), "upper").when(value.rlike("[a-z]"), "lower").otherwise("none")),
            F.concat(F.lit("words "), F.when(before.rlike(NAMES_BEFORE) | before.rlike(CONTEXT[kind]), "named").otherwise("bare")),
        )
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), votes.alias("votes"),
            F.transform(features, lambda f: F.concat(F.lit(kind + " "), f)).alias("features"),
        )

    found = find_spans(text, pattern)
    if base:
        found = F.filter(found, lambda s: _valid(kind, s["value"]))
    gate = text.rlike(GATES.get((kind, base), _DIGIT))
    return F.when(gate, F.transform(found, judge)).otherwise(F.array().cast(CANDIDATES))


CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<string>>>"


def candidates(text: Column) -> Column:
    """All candidates of a text: base spans by kind and start, then others that overlap no base span."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[_candidates_of(k, text, BASE[k], True) for k in BASE])
    wide = F.concat(*[_candidates_of(k, text, WIDE[k], False) for k in WIDE])

    def free(both: Column) -> Column:
        clear = F.filter(both["wide"], lambda w: ~F.exists(both["base"], lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
        return F.concat(both["base"], clear)

    return let(F.struct(base.alias("base"), wide.alias("wide")), free)


def fit_labelers(found: DataFrame) -> DataFrame:
    """EM over vote patterns; one row: model (prior per kind, accuracy per labeler).

    A labeler that votes is right with its accuracy, whatever the class; accuracies have a
    Beta(8, 2) prior and stay above chance, so the classes cannot change places.
    """
    patterns = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    table = patterns.agg(F.collect_list(F.struct("kind", "votes", F.col("n").cast("double").alias("n"))).alias("pats"))
    start = F.struct(F.array(*[F.lit(0.5)] * len(KINDS)).alias("prior"), F.array(*[F.lit(0.8)] * len(LABELERS)).alias("accuracy"))

    def step(model: Column, _: Column) -> Column:
        one = lambda p: F.struct(p["kind"].alias("kind"), p["votes"].alias("votes"), p["n"].alias("n"), posterior(model, p["kind"], p["votes"]).alias("q"))

        def update(ps: Column) -> Column:
            total = lambda weight: F.aggregate(ps, F.lit(0.0), lambda a, p: a + p["n"] * weight(p))

            def prior(k: int) -> Column:
                mine = lambda p: (p["kind"] == k).cast("double")
                return (total(lambda p: mine(p) * p["q"]) + SMOOTH) / (total(mine) + 2 * SMOOTH)

            def accuracy(j: int) -> Column:
                right = total(lambda p: F.when(p["votes"][j] > 0, p["q"]).when(p["votes"][j] < 0, 1 - p["q"]).otherwise(0.0))
                voted = total(lambda p: (p["votes"][j] != 0).cast("double"))
                return F.least(F.greatest((right + 8) / (voted + 10), F.lit(0.55)), F.lit(0.99))

            return F.struct(
                F.array(*[prior(k) for k in range(len(KINDS))]).alias("prior"), F.array(*[accuracy(j) for j in range(len(LABELERS))]).alias("accuracy")
            )

        return let(F.transform("pats", one), update)

    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("model"))


def posterior(model: Column, kind: Column, votes: Column) -> Column:
    """P(personal | votes) under the fitted accuracies."""
    odds = lambda x: F.log(x / (1 - x))
    total = odds(F.least(F.greatest(model["prior"][kind], F.lit(0.01)), F.lit(0.99)))
    for j in range(len(LABELERS)):
        total = total + votes[j] * odds(model["accuracy"][j])
    return 1 / (1 + F.exp(-total))


def fit_classifier(found: DataFrame, labelers: DataFrame) -> DataFrame:
    """Naive Bayes from soft labels; one row: model and log-odds per feature (a bounded set of buckets)."""
    spans = found.select(F.explode("cands").alias("c")).crossJoin(F.broadcast(labelers))
    spans = spans.select("c.kind", "c.features", posterior(F.col("model"), F.col("c.kind"), F.col("c.votes")).alias("q"))
    exact = F.round(F.col("q"), 6).cast("decimal(28,6)")  # sums that do not depend on their order
    sums = spans.select("kind", F.explode("features").alias("feature"), exact.alias("q")).groupBy("kind", "feature")
    sums = sums.agg(F.sum("q").cast("double").alias("yes"), F.count("*").cast("double").alias("n"))
    whole = spans.select("kind", exact.alias("q")).groupBy("kind").agg(F.sum("q").cast("double").alias("yes"), F.count("*").cast("double").alias("n"))
    whole = whole.select("kind", ((F.col("yes") + SMOOTH) / (F.col("n") + 2 * SMOOTH)).alias("rate"))
    # a rarely seen bucket leans to its kind, so that being rare alone says nothing
    yes, no = F.col("yes") + SMOOTH * F.col("rate"), F.col("n") - F.col("yes") + SMOOTH * (1 - F.col("rate"))
    odds = sums.join(F.broadcast(whole), "kind").select("feature", F.log(yes / no).alias("odds"))  # one row per kind
    named = whole.select(F.concat(F.lit("kind "), F.col("kind").cast("string")).alias("feature"), F.log(F.col("rate") / (1 - F.col("rate"))).alias("odds"))
    table = odds.unionByName(named).agg(F.map_from_entries(F.collect_list(F.struct("feature", "odds"))).alias("odds"))
    return table.crossJoin(F.broadcast(labelers))


def score_span(span: Column, odds: Column) -> Column:
    """Probability of the span classifier: kind log-odds plus each feature's shift from it."""
    prior = F.coalesce(F.try_element_at(odds, F.concat(F.lit("kind "), span["kind"].cast("string"))), F.lit(0.0))
    shift = F.aggregate(span["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(odds, f) - prior, F.lit(0.0)))
    return 1 / (1 + F.exp(-(prior + shift)))


def accepted(cands: Column, odds: Column) -> Column:
    """Base spans and accepted others, by kind and start: array of (kind, start, end, base)."""
    good = F.filter(cands, lambda c: c["base"] | (score_span(c, odds) >= THRESHOLD))
    return F.sort_array(F.transform(good, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))


def fit_pii(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(candidates per document, one-row model); both written to the shared folder."""
    ident = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    found = materialize(docs.select(ident.alias("doc_id"), candidates(F.col(text_col)).alias("cands")), "pii-candidates")
    model = materialize(fit_classifier(found, materialize(fit_labelers(found), "pii-labelers")), "pii-model")
    return found, model


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per document: doc_id, base counts n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans."""
    with Scope() as done:
        found, model = fit_pii(docs, text_col)
        spans = found.crossJoin(F.broadcast(model)).select("doc_id", accepted(F.col("cands"), F.col("odds")).alias("all"))
        spans = spans.withColumn("own", F.filter("all", lambda s: s["base"]))
        of_kind = lambda i: F.size(F.filter("own", lambda s: s["kind"] == i)).cast("long")
        counts = [of_kind(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:4])]
        return done(spans.select(
            "doc_id", *counts, F.sha2(_joined(F.col("own")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"),
            (F.size("all") - F.size("own")).cast("long").alias("n_added"), F.size("all").cast("long").alias("n_spans"),
        ))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one mark."""
    with Scope() as done:
        model = done(fit_pii(docs, text_col)[1], "pii-fitted")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(f"row.`{text_col}`")
    spans = accepted(candidates(text), F.col("odds"))
    by_start = lambda s: F.sort_array(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def rebuild(s: Column) -> Column:
        first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def add(acc: Column, x: Column) -> Column:
            piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(marks, x["kind"]))
            return F.struct(F.when(x["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

        done = F.aggregate(s, first, add)
        return let(done, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1, F.length(text))))

    marked = docs.select(row).crossJoin(F.broadcast(model.select("odds")))  # one row
    clean = let(spans, lambda s: F.when(F.size(s) > 0, rebuild(by_start(s))).otherwise(text))
    columns = [clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return marked.select(*columns)
