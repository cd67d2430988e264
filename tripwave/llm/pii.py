"""Personal data by weak supervision, with DataFrame functions only.

Base patterns give the spans that always stay. Looser patterns give candidates; on each
five labelers vote or abstain: a strict pattern, a checksum, a gazetteer, the words before
it, and its borders. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is and how likely a pattern is personal data; these soft labels
train a naive Bayes span classifier on votes and shape, which decides on the candidates.
What is gathered from the corpus is one count per kind, vote pattern and shape.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tripwave.operators.ordered import materialize

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:int,start:long,end:long>>"

# Fixed patterns of the base spans. Possessive and anchored at the start of a run, so that
# time stays linear and the stack flat on long runs; they match what the plain forms match.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

CANDIDATE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+(?:@| ?[\[(][aA][tT][\])] ?)[A-Za-z0-9-]++"
             r"(?:(?:\.| ?[\[(][dD][oO][tT][\])] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold to be searched at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE_HINT = {"email": r"@|(?i)[\[(]at[\])]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}"}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": rf"^{OCTET}(?:\.{OCTET}){{3}}$|^[0-9A-Fa-f:]+$",
    "card": r"^(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$",
}
# Fixed gazetteers: top-level domains, card issuers, calling codes, and words that announce a kind.
GAZETTEER = {
    "email": r"(?i)\b(?:com|org|net|edu|gov|info|io|biz|de|fr|es|uk|it|nl|eu|ch|at|us|ca)$",
    "ip": r"^(?!0+\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9])",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|correo|courriel)\W*$",
    "ip": r"(?i)(?:\bip|address|host|server|adresse)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|number|no)\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|telefon|tel[eé]fono)\W*$",
}
# What is held of the labelers before any data: chance of a yes on personal data, and on
# other text. A checksum passes one random number in ten and every real one.
HELD = ((0.8, 0.4), (0.99, 0.1), (0.9, 0.3), (0.8, 0.2), (0.9, 0.5))
N_VOTES = len(HELD)


@dataclass(frozen=True)
class WeakRules:
    """``rounds`` of expectation-maximisation, with ``pseudo`` votes for what is held of each labeler
    beforehand; candidates from ``min_score`` log odds are kept."""

    rounds: int = 25
    pseudo: float = 50.0
    context: int = 24
    min_score: float = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(values: Column, step: int = 128) -> Column:
    """Running sums of an array, in pieces, so that time is nearly linear."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    def summed(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step).cast("int"))
        return let(F.struct(a.alias("a"), F.transform(at, lambda c: total(F.slice(a, c * step + 1, step))).alias("sums")),
                   lambda s: F.flatten(F.transform(at, lambda c: let(
                       F.struct(F.slice(s["a"], c * step + 1, step).alias("part"), total(F.slice(s["sums"], 1, c)).alias("before")),
                       lambda t: F.transform(t["part"], lambda x, i: t["before"] + total(F.slice(t["part"], 1, i + 1)))))))

    return F.when(F.size(values) > 0, let(values, summed)).otherwise(F.array().cast("array<long>"))


def matches(text: Column, pattern: str, hint: str, context: int = 0) -> Column:
    """All matches of ``pattern`` as (start, end, text, before, after), in code points; texts without ``hint`` are not searched.

    ``before`` has up to ``context`` characters since the last match, ``after`` the one that follows.
    """

    def placed(s: Column) -> Column:
        n = F.size(s["hits"])
        before = F.slice(s["gaps"], 1, n)
        steps = F.zip_with(s["hits"], before, lambda hit, gap: (F.length(hit) + F.length(gap)).cast("long"))
        around = F.zip_with(before, F.slice(s["gaps"], 2, n), lambda gap, next_: F.struct(
            F.right(gap, F.lit(context)).alias("before"), F.left(next_, F.lit(1)).alias("after")))
        hits = F.zip_with(s["hits"], around, lambda hit, x: F.struct(hit.alias("text"), x["before"].alias("before"), x["after"].alias("after")))
        return F.zip_with(prefix_sums(steps), hits, lambda end, hit: F.struct(
            (end - F.length(hit["text"])).alias("start"), end.alias("end"), hit["text"].alias("text"), hit["before"].alias("before"),
            hit["after"].alias("after")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<start:long,end:long,text:string,before:string,after:string>>")
    return F.when(text.rlike(hint), let(both, placed)).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_holds(kind: str, hit: Column) -> Column:
    number = digits(hit["text"])
    return {"email": F.lit(True), "ip": hit["text"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
            "card": F.length(number).between(13, 19) & F.call_function("luhn_check", number), "phone": F.length(number).between(9, 15)}[kind]


def base_spans(text: Column) -> Column:
    """Base spans by kind and start."""

    def of(kind: str) -> Column:
        hits = F.filter(matches(text, BASE[kind], HINT[kind]), lambda h: base_holds(kind, h))
        return F.transform(hits, lambda h: F.struct(F.lit(KINDS.index(kind)).alias("kind"), h["start"].alias("start"), h["end"].alias("end")))

    return F.concat(*[of(k) for k in KINDS]).cast(SPAN)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def _border(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9A-Za-z]"), "word").otherwise("mark")


def candidates(text: Column, rules: WeakRules) -> Column:
    """Candidate spans with their votes, one letter a labeler, and their shape."""

    def of(kind: str) -> Column:
        def labelled(h: Column) -> Column:
            hit, number = h["text"], digits(h["text"])
            before, after = h["before"], h["after"]
            prev = F.right(before, F.lit(1))
            strict = hit.rlike(STRICT[kind])
            check = {"email": ~hit.contains(".."), "ip": strict, "card": F.call_function("luhn_check", number), "phone": F.length(number).between(9, 15)}[kind]
            listed = hit.rlike(GAZETTEER[kind])
            votes = F.concat(
                _vote(strict, ~strict), _vote(check, ~check),
                _vote(listed, ~listed & ~hit.startswith("(")) if kind != "phone" else _vote(listed, hit.startswith("+") & ~listed),
                _vote(before.rlike(CONTEXT[kind]), before.rlike(r"""[=/_"']$""")),
                _vote(~prev.rlike(r"[0-9A-Za-z_@=]") & ~after.rlike("[0-9A-Za-z_@=]"), prev.rlike("[0-9A-Za-z_=]") | after.rlike("[0-9A-Za-z_=]")))
            shape = F.concat_ws("|", F.least(F.length(number), F.lit(20)), _border(prev), _border(after),
                                F.regexp_replace(F.regexp_replace(hit, "[0-9A-Za-z]+", ""), r"(.)\1+", "$1").substr(1, 4))
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), h["start"].alias("start"), h["end"].alias("end"),
                            votes.alias("votes"), shape.alias("shape"))

        return F.transform(matches(text, CANDIDATE[kind], CANDIDATE_HINT[kind], rules.context), labelled)

    return F.concat(*[of(k) for k in KINDS])


def reliabilities(patterns: Column, rules: WeakRules) -> Column:
    """Expectation-maximisation over (n, votes): the class prior, then each labeler's chance of a yes on either class.

    Labelers are taken to be independent given the class. Pseudo-counts hold them to what is
    known beforehand until the data say otherwise, which also keeps the classes apart.
    """
    labelers = F.sequence(F.lit(0), F.lit(N_VOTES - 1))

    def summed(rows: Column, weight) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, p: s + weight(p))

    def step(state: Column, _: Column) -> Column:
        soft = F.transform(patterns, lambda p: F.struct(p["n"].alias("n"), p["votes"].alias("votes"), posterior(p["votes"], state).alias("q")))

        def updated(rows: Column) -> Column:
            def chance(side: int, weight) -> Column:
                held = F.array(*[F.lit(h[side] * rules.pseudo) for h in HELD])
                return F.transform(labelers, lambda j: (F.get(held, j) + summed(F.filter(
                    rows, lambda p: F.substring(p["votes"], j + 1, F.lit(1)) == "y"), weight)) / (F.lit(rules.pseudo) + summed(F.filter(
                        rows, lambda p: F.substring(p["votes"], j + 1, F.lit(1)) != "-"), weight)))

            one, zero = (lambda p: p["n"] * p["q"]), (lambda p: p["n"] * (F.lit(1.0) - p["q"]))
            prior = (F.lit(1.0) + summed(rows, one)) / (F.lit(2.0) + summed(rows, lambda p: p["n"]))
            return F.concat(F.array(prior), chance(0, one), chance(1, zero))

        return let(soft, updated)

    start = F.array(F.lit(0.5), *[F.lit(h[0]) for h in HELD], *[F.lit(h[1]) for h in HELD])
    return F.aggregate(F.sequence(F.lit(1), F.lit(rules.rounds)), start, step)


def posterior(votes: Column, state: Column) -> Column:
    """Chance that a vote pattern is personal data."""

    def odds(acc: Column, j: Column) -> Column:
        vote, one, zero = F.substring(votes, j + 1, F.lit(1)), F.get(state, j + 1), F.get(state, j + 1 + N_VOTES)
        return acc + F.when(vote == "y", F.ln(zero / one)).when(vote == "n", F.ln((1 - zero) / (1 - one))).otherwise(F.lit(0.0))

    against = F.aggregate(F.sequence(F.lit(0), F.lit(N_VOTES - 1)), F.ln((1 - F.get(state, F.lit(0))) / F.get(state, F.lit(0))), odds)
    return 1 / (1 + F.exp(against))


def features(votes: Column, shape: Column) -> Column:
    """Names of a candidate's features: each vote, and each part of the shape."""
    votes_ = F.transform(F.sequence(F.lit(0), F.lit(N_VOTES - 1)), lambda j: F.concat(F.lit("v"), j.cast("string"), F.substring(votes, j + 1, F.lit(1))))
    return F.concat(votes_, F.transform(F.split(shape, r"\|", 4), lambda part, i: F.concat(F.lit("s"), i.cast("string"), part)))


def train(texts: DataFrame, rules: WeakRules = WeakRules()) -> dict[str, float]:
    """Weights of the span classifier by ``kind:feature``, and its bias by ``kind:``.

    Counts come from all texts. Their number is bounded by the patterns: 243 votes, and a
    few hundred shapes a kind; the weights are fewer, and only they reach the driver.
    """
    found = texts.select(F.explode(candidates(F.coalesce("text", F.lit("")), rules)).alias("c")).select("c.kind", "c.votes", "c.shape")
    counts = materialize(found.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).cast("double").alias("n")))
    patterns = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).groupBy("kind").agg(
        F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    states = patterns.select("kind", reliabilities(F.col("patterns"), rules).alias("state"))
    soft = counts.join(states, "kind").withColumn("q", posterior(F.col("votes"), F.col("state")))
    one, zero = F.sum(F.col("n") * F.col("q")), F.sum(F.col("n") * (1 - F.col("q")))
    bias = soft.groupBy("kind").agg(one.alias("one"), zero.alias("zero"))
    by = soft.withColumn("feature", F.explode(features(F.col("votes"), F.col("shape")))).groupBy("kind", "feature").agg(
        one.alias("a"), zero.alias("b")).join(bias, "kind")
    weights = by.select("kind", "feature", (F.ln((F.col("a") + 1) / (F.col("one") + 2)) - F.ln((F.col("b") + 1) / (F.col("zero") + 2))).alias("w"))
    weights = weights.unionByName(bias.select("kind", F.lit("").alias("feature"), F.ln((F.col("one") + 1) / (F.col("zero") + 1)).alias("w")))
    return {f"{r['kind']}:{r['feature']}": r["w"] for r in weights.collect()}


def accepted(spans: Column, weights: dict[str, float], rules: WeakRules) -> Column:
    """Candidates that the classifier takes for personal data."""
    if not weights:
        return F.filter(spans, lambda c: F.lit(False))
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])

    def score(c: Column) -> Column:
        names = F.concat(F.array(F.lit("")), features(c["votes"], c["shape"]))
        return F.aggregate(names, F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(table, F.concat(c["kind"].cast("string"), F.lit(":"), f)), F.lit(0.0)))

    return F.filter(spans, lambda c: score(c) >= rules.min_score)


def find(docs: DataFrame, rules: WeakRules = WeakRules(), weights: dict[str, float] | None = None) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans of every document, as (kind number, start, end) in code points.

    Base spans always stay; a candidate that the classifier accepts is added where no base
    span is. NULL texts count as empty and, like texts without a match, have no spans;
    repeated rows are searched one by one; an empty table gives no rows and trains nothing.
    Without ``weights`` the classifier is trained on ``docs``.
    """
    weights = train(docs, rules) if weights is None else weights
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    added = accepted(candidates(F.col("text"), rules), weights, rules)

    def split(s: Column) -> Column:
        fresh = F.transform(F.array_except(_codes(s["added"]), _codes(s["base"])), _span)
        apart = F.filter(fresh, lambda c: ~F.exists(s["base"], lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
        return F.struct(s["base"].alias("base"), apart.alias("added"))

    both = let(F.struct(base_spans(F.col("text")).alias("base"), added.alias("added")), split)
    return rows.select("doc_id", both.alias("s")).select("doc_id", "s.base", "s.added")


def _codes(spans: Column) -> Column:
    """Spans as numbers, which array functions compare by hash; they hold lengths below 2**24."""
    length = lambda s: F.least(s["end"] - s["start"], F.lit((1 << 24) - 1))
    return F.transform(spans, lambda s: F.shiftleft(F.shiftleft(s["start"], 24) + length(s), 2) + s["kind"])


def _span(code: Column) -> Column:
    start = F.shiftright(code, 26)
    return F.struct(code.bitwiseAND(F.lit(3)).cast("int").alias("kind"), start.alias("start"),
                    (start + F.shiftright(code, 2).bitwiseAND(F.lit((1 << 24) - 1))).alias("end"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans by kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
