"""Personal data by weak supervision, in built-in functions only.

Base spans are strict: the leftmost matches of one pattern per kind that pass the kind's test. Weaker
candidates (obfuscated addresses, phone numbers without a plus, card numbers that fail their check digit) are
found beside them. Four labelers vote on every candidate, yes, no or nothing: the strict pattern, a gazetteer
of domains, issuers and networks, the words before the span, and the span's shape. Expectation-maximisation
estimates each labeler's reliability for each kind from the counts of vote patterns over the whole corpus;
its posteriors are the soft labels on which a logistic span classifier over votes and form is trained.
Candidates that it accepts and that overlap no base span of their kind join the base spans, which always stay.

Everything a text needs is computed in its own row, and one narrow table of candidates is written. Vote
patterns are at most 4 kinds x 81 votes x 3 forms; both training loops are folds over them in one expression,
and the accepted patterns are what comes back. Patterns begin only where a run begins and repeat without
backtracking, so that long runs of digits or letters stay linear; positions are summed in two levels, so
that many matches in one text do too.

Edge cases: null and empty texts have no spans (counts 0, the hash of the empty string). Repeated rows each
come back. Positions are code points. Without any candidate nothing is learned or added. Other columns do not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import text_of
from flowloom.session import stored

KINDS = ("email", "ip", "card", "phone")
FORMS = ("base", "weak", "other")
LABELERS = 4
EM_ROUNDS = 30
DESCENT_ROUNDS = 200
ACCEPT = 0.9
CONTEXT = 40
LEVEL = 256

LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
EMAIL = LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WRITTEN_EMAIL = LOCAL + r"\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.)-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

# fixed values: well-known top-level domains, issuer prefixes of cards, and words that announce a kind
DOMAINS = r"(?i)(?:\.|dot[)\]]\s?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
LOCAL_NETWORKS = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
AREAS = r"^\+?\D*(?:1\D|33|34|39|4[0-9]|[2-9][0-9]{2}\D)"
ANNOUNCED = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write to)\W*\s*\S*$",
    "ip": r"(?i)(?:\bip\b|address|adresse|direcci|server|host)\W*\s*\S*$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|master|amex)\W*\s*\S*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobil|anruf|appel)\W*\s*\S*$",
}
DENIED = {
    "email": r"(?i)(?:import|class|decorator)\W*$",
    "ip": r"(?i)(?:version|ver|release|v)\W*$",
    "card": r"(?i)(?:order|invoice|isbn|serial|account|nr|no)\W*$",
    "phone": r"(?i)(?:order|invoice|isbn|serial|id)\W*$",
}


def matches(text: Column, pattern: str, here: Column) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; none where ``here`` is false.

    The pieces between the matches give the positions: one fold over sums of LEVEL matches each, and one
    short fold inside each of them. Only texts with a match get there, so the sequence never runs backwards.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    pairs = F.zip_with(values, F.slice(pieces, F.lit(1), F.size(values)),
                       lambda v, p: F.struct(F.char_length(p).alias("gap"), F.char_length(v).alias("long"), v.alias("value")))

    def place(state, pair):
        start = state["at"] + pair["gap"]
        end = start + pair["long"]
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(F.struct(
            start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("done"))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / LEVEL).cast("int") - 1),
                         lambda g: F.slice(pairs, g * LEVEL + 1, F.lit(LEVEL)))

    def chain(state, group):
        length = F.aggregate(group, F.lit(0), lambda s, p: s + p["gap"] + p["long"])
        inner = F.aggregate(group, F.struct(state["at"].alias("at"), empty.alias("done")), place)["done"]
        return F.struct((state["at"] + length).alias("at"), F.concat(state["done"], F.array(inner)).alias("done"))

    nested = F.expr("cast(array() as array<array<struct<start:int,end:int,value:string>>>)")
    found = F.flatten(F.aggregate(groups, F.struct(F.lit(0).alias("at"), nested.alias("done")), chain)["done"])
    return F.when(here & text.rlike(pattern), found).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")).between(0, 3)
                        & (F.substring(F.concat(F.lit("00"), F.regexp_replace(part, "^0+", "")), -3, 3).cast("int") <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, value: Column, before: Column, form: Column) -> list[Column]:
    """yes 2, no 0, nothing 1: strict pattern, gazetteer, words before, shape."""
    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 2).when(no, 0).otherwise(1)

    strict = vote(form == "base", form == "weak")
    digits = _digits(value)
    known = {
        "email": lambda: vote(value.rlike(DOMAINS), F.lit(False)),
        "ip": lambda: vote(~value.rlike(LOCAL_NETWORKS), value.rlike(LOCAL_NETWORKS)),
        "card": lambda: vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
        "phone": lambda: vote(value.rlike(AREAS), F.lit(False)),
    }[kind]()
    shape = {
        "email": lambda: vote(~value.rlike("^[.]|[.]{2}"), value.rlike("^[.]|[.]{2}")),
        "ip": lambda: vote(~value.rlike(r"(?:^|\.)0[0-9]"), value.rlike(r"(?:^|\.)0[0-9]")),
        "card": lambda: vote(F.length(digits).isin(15, 16) & value.rlike(r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{4})?)$"),
                             ~F.length(digits).isin(13, 15, 16, 19)),
        "phone": lambda: vote(value.rlike(r"\) ?|[0-9][ -][0-9]{3}[ -]"), value.rlike(r"\.[0-9]{1,2}$|[.-]{2}")),
    }[kind]()
    return [strict, known, vote(before.rlike(ANNOUNCED[kind]), before.rlike(DENIED[kind])), shape]


def _labelled(kind: str, found: Column, text: Column, form) -> Column:
    """Candidates as struct(kind, start, end, base, code); code joins kind, form and votes."""
    def one(c):
        own = form(c["value"])
        first = F.greatest(F.lit(1), c["start"] + 1 - CONTEXT)
        before = F.substring(text, first, c["start"] + 1 - first)
        votes = F.concat(*[v.cast("string") for v in _votes(kind, c["value"], before, own)])
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                        (own == "base").alias("base"), F.concat_ws(":", F.lit(kind), own, votes).alias("code"))

    return F.transform(found, one)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): all base spans and weaker candidates of every text."""
    text = F.col("__text")
    framed = docs.select(F.col(f"`{id_column}`").alias("doc_id"), text_of(text_column).alias("__text"))
    digit, at, plus = text.rlike("[0-9]"), F.instr(text, "@") > 0, F.instr(text, "+") > 0
    written = text.rlike(r"(?i)[(\[]at[)\]]")

    def strict(kind):
        return lambda value: F.when(valid(kind, value), F.lit("base")).otherwise(F.lit("weak"))

    def other(value):
        return F.lit("other")

    found = F.concat(
        _labelled("email", matches(text, EMAIL, at), text, strict("email")),
        _labelled("ip", matches(text, IP, digit), text, strict("ip")),
        _labelled("card", matches(text, CARD, digit), text, strict("card")),
        _labelled("phone", matches(text, PHONE, plus), text, strict("phone")),
        _labelled("email", matches(text, WRITTEN_EMAIL, written), text, other),
        _labelled("phone", matches(text, LOCAL_PHONE, digit), text, other))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,base:boolean,code:string>>)")
    return framed.select("doc_id", F.when(digit | at | written, found).otherwise(none).alias("spans"))


def reliabilities(patterns: Column, rounds: int = EM_ROUNDS) -> Column:
    """struct(prior, yes, no, chance) from array<struct<votes array<int>, n double>> of one kind.

    ``yes`` and ``no`` hold P(vote | class), three numbers a labeler; ``chance`` the patterns' posteriors.
    Odd steps compute posteriors, even steps reliabilities.
    """
    width = 3 * LABELERS

    def product(table, votes):
        return F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), F.lit(1.0),
                           lambda p, j: p * F.element_at(table, j * 3 + F.element_at(votes, j + 1) + 1))

    def posterior(s):
        def one(p):
            yes, no = s["prior"] * product(s["yes"], p["votes"]), (1 - s["prior"]) * product(s["no"], p["votes"])
            return yes / (yes + no)
        return F.transform(patterns, one)

    def shares(s, inverse):
        weight = F.zip_with(patterns, s["chance"], lambda p, q: p["n"] * ((1 - q) if inverse else q))
        total = F.aggregate(weight, F.lit(0.0), lambda a, w: a + w)

        def one(m):
            labeler, vote = F.floor(m / 3).cast("int") + 1, m % 3
            hit = F.zip_with(patterns, weight, lambda p, w: F.when(F.element_at(p["votes"], labeler) == vote, w).otherwise(0.0))
            return (F.aggregate(hit, F.lit(0.0), lambda a, w: a + w) + 1.0) / (total + 3.0)
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), one)

    def prior(s):
        held = F.aggregate(F.zip_with(patterns, s["chance"], lambda p, q: p["n"] * q), F.lit(0.0), lambda a, w: a + w)
        return (held + 1.0) / (F.aggregate(patterns, F.lit(0.0), lambda a, p: a + p["n"]) + 2.0)

    def step(s, i):
        posteriors = i % 2 == 1
        return F.struct(F.when(posteriors, s["prior"]).otherwise(prior(s)).alias("prior"),
                        F.when(posteriors, s["yes"]).otherwise(shares(s, False)).alias("yes"),
                        F.when(posteriors, s["no"]).otherwise(shares(s, True)).alias("no"),
                        F.when(posteriors, posterior(s)).otherwise(s["chance"]).alias("chance"))

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(x) for x in (0.1, 0.3, 0.6) * LABELERS]).alias("yes"),
                     F.array(*[F.lit(x) for x in (0.6, 0.3, 0.1) * LABELERS]).alias("no"),
                     F.transform(patterns, lambda p: F.lit(0.5)).alias("chance"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * rounds + 1)), start, step)


def _features(votes: Column, form: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), F.transform(votes, lambda v: v.cast("double") - 1.0),
                    F.array((form == "weak").cast("double"), (form == "other").cast("double")))


def _dot(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def span_classifier(examples: Column, rounds: int = DESCENT_ROUNDS, rate: float = 1.0) -> Column:
    """Logistic weights from array<struct<x array<double>, y double, n double>>, by gradient descent."""
    width = LABELERS + 3
    total = F.aggregate(examples, F.lit(0.0), lambda s, e: s + e["n"])

    def step(weights, _):
        errors = F.transform(examples, lambda e: e["n"] / total * (1.0 / (1.0 + F.exp(-_dot(weights, e["x"]))) - e["y"]))
        return F.transform(weights, lambda w, m: w * (1.0 - 1e-4) - rate * F.aggregate(
            F.zip_with(examples, errors, lambda e, r: F.element_at(e["x"], m + 1) * r), F.lit(0.0), lambda s, v: s + v))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array_repeat(F.lit(0.0), width), step)


def learn(found: DataFrame) -> DataFrame:
    """(kind, prior, yes, no, weights, code, n, posterior, chance): one row per pattern that occurs."""
    counts = found.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).cast("double").alias("n"))
    parts = F.split("code", ":")
    named = counts.select("code", "n", parts[0].alias("kind"), parts[1].alias("form"),
                          F.transform(F.split(parts[2], ""), lambda v: v.cast("int")).alias("votes"))
    # 243 patterns a kind at most
    grouped = named.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("code", "form", "votes", "n"))).alias("patterns"))
    fitted = stored(grouped.withColumn("em", reliabilities(F.col("patterns"))), "reliabilities")
    examples = F.zip_with("patterns", "em.chance", lambda p, q: F.struct(
        _features(p["votes"], p["form"]).alias("x"), q.alias("y"), p["n"].alias("n"), p["code"].alias("code")))
    taught = fitted.withColumn("examples", examples).withColumn("weights", span_classifier(F.col("examples")))
    return taught.select("kind", "em.prior", "em.yes", "em.no", "weights", F.explode("examples").alias("e")).select(
        "kind", "prior", "yes", "no", "weights", F.col("e.code").alias("code"), F.col("e.n").alias("n"), F.col("e.y").alias("posterior"),
        (1.0 / (1.0 + F.exp(-_dot(F.col("weights"), F.col("e.x"))))).alias("chance"))


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, base, spans): sorted arrays of struct(start, kind, end) per text; base ones are in both."""
    found = stored(candidates(docs, id_column, text_column), "candidates")
    accepted = [r["code"] for r in learn(found).where(F.col("chance") >= ACCEPT).where(~F.col("code").contains(":base:")).select("code").collect()]
    base = F.filter("spans", lambda s: s["base"])
    chosen = F.filter("spans", lambda s: s["base"] | (s["code"].isin(accepted) if accepted else F.lit(False)))

    def apart(s):
        return s["base"] | ~F.exists("base", lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def ordered(spans):
        return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))

    both = found.withColumn("base", base).withColumn("chosen", chosen)
    return both.select("doc_id", ordered("base").alias("base"), ordered(F.filter("chosen", apart)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))
