"""Personal data by weak supervision, in DataFrame expressions only.

Four base kinds are found by fixed patterns. Beyond them, proposers mark candidate spans (secrets, social security
numbers, bank accounts, phone numbers without a country, street addresses, names). Shape and checksum rules, gazetteers
and labelers of the context before and after vote on each candidate. Only the counts of vote patterns, whose number the
labelers bound, reach the driver; expectation-maximisation there estimates how reliable each labeler is for each kind, without
labels, and its posteriors train a logistic span classifier. The classifier is one expression over votes, so the final pass is
again a plain projection. No row is ever shuffled.

Positions: splitting at a pattern gives the texts between its matches, so starts are running sums of lengths.
Patterns use possessive loops, which match the same spans as greedy ones here and never recurse on long runs.

Columns of find_personal_data: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

Defined cases: a null text counts as empty (no spans, the hash of the empty string); positions count code points, end
exclusive; candidates that overlap a base span are not added; without candidates nothing is trained or added; repeated
rows are judged each; an empty table gives an empty result; any further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.llm.common import checkpointed, pick

#: The base patterns, by kind in the order that breaks ties. A match that starts inside a run of a kind's
#: first characters could only fail where the run's start failed, so starts are tried at run starts and where the
#: previous match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A character that every match of the kind has.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
BASE = tuple(PATTERNS)
#: Given names that are frequent in English, German, French and Spanish, a public-knowledge gazetteer.
GIVEN = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Dorothy Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Alice "
    "Hans Peter Wolfgang Klaus Jürgen Dieter Manfred Uwe Stefan Andreas Matthias Jens Ursula Monika Petra Sabine Renate Helga Karin Brigitte Ingrid Anna Julia Katharina "
    "Jean Pierre Michel André Philippe Alain Bernard Jacques François Nicolas Laurent Marie Nathalie Isabelle Sylvie Catherine Monique Françoise Camille Chloé "
    "José Antonio Juan Manuel Francisco Luis Javier Carlos Miguel Pedro Alejandro Fernando María Carmen Josefa Isabel Dolores Pilar Teresa Lucía Elena Sofía"
).split()
#: The length of an international bank account number by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Señor|Señora"
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way"
#: Proposers of further spans, in order of preference where they overlap.
PROPOSERS = {
    "secret": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])|(?<=[=:] ?[\"'])[A-Za-z0-9+/_-]{20,}+(?=[\"'])|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "address": rf"(?<![0-9A-Za-z])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:{_STREETS})(?![A-Za-z])",
    "name": rf"(?<![A-Za-z])(?:(?:{_TITLES})\.? [A-Z]\p{{Ll}}{{1,30}}+(?: [A-Z]\p{{Ll}}{{1,30}}+)?+|(?:{'|'.join(GIVEN)})(?: [A-Z]\.)? [A-Z]\p{{Ll}}{{1,30}}+)(?![A-Za-z])",
}
ADDED = tuple(PROPOSERS)
#: Cue words of the context labelers by kind: what may stand close before a span, anywhere in the context before it, and after it.
CUES = {
    "secret": ("token|secret|password|passwd|pwd|key|bearer|auth", "credential|login|api|access|private", "expires|revoked|rotated"),
    "ssn": ("ssn|social|security|number|no", "insurance|tax|identity", "on file|born|dob"),
    "iban": ("iban|account|konto|cuenta|compte", "bank|transfer|pay|payment|überweisung", "bic|swift|eur"),
    "local_phone": ("tel|phone|call|mobile|cell|fax|at", "contact|reach|dial|ring|text", "ext|extension|mobile|fax"),
    "address": ("at|address|lives|resides|to|in", "ship|mail|visit|home|office|deliver", "apt|suite|floor|[0-9]{5}"),
    "name": ("dear|name|patient|contact|signed|author|from|by|is|hello|hi", "customer|client|employee|met|called|wrote|regards", "wrote|said|born|lives|works|called"),
}
#: Words that are names' or secrets' unlikely content.
COMMON = "the|and|of|public|general|license|example|test|sample|lorem|software|copyright|university|street|version"
#: Characters looked at before a candidate, right before it, and after it.
CONTEXT, NEAR, AFTER = 48, 16, 24
LABELERS = ("shape", "checksum", "gazetteer", "near", "far", "after", "assigned", "quoted", "common", "repeats")
#: Matches whose positions are summed in one run; runs are chained.
RUN = 256
#: Code points of a block of text.
BLOCK = 1024
#: EM and training steps; the added weight of each labeler's prior.
STEPS, PRIOR = 60, 2.0
#: Candidates that the estimates over all kinds count as in a kind's own.
BORROWED = 50.0


def _matches(text: Column, kind: str, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<string>")
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(empty) if needs else found


def _positions(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<gap, size, body>> of a pattern's matches: code points since the last match, own code points, and the match."""
    between = F.split(text, pattern, -1)
    return F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, body: F.struct(F.length(gap).alias("gap"), F.length(body).alias("size"), body.alias("body")))


def _running(sized: Column) -> Column:
    """Starts and ends from gaps and sizes, RUN at a time."""
    kind = "array<struct<start:int,end:int,body:string>>"
    nothing = F.array().cast(kind)

    def grow(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["body"].alias("body"))
        return F.struct((start + x["size"]).alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    def chain(s: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end"), x["body"].alias("body")))
        return F.struct((s["at"] + r["at"]).alias("at"), F.concat(s["out"], moved).alias("out"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sized) - 1) / RUN).cast("int")), lambda r: F.aggregate(F.slice(sized, r * RUN + 1, F.lit(RUN)), start, grow))
    return F.when(F.size(sized) == 0, nothing).otherwise(F.aggregate(runs, start, chain)["out"])


def _luhn(body: Column) -> Column:
    digits = F.reverse(F.filter(F.split(body, ""), lambda c: c.rlike("^[0-9]$")))
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return body.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((digits >= 12) & (digits <= 19), _luhn(body)).otherwise(F.lit(False))
    if kind == "phone":
        return (digits >= 9) & (digits <= 15)
    return F.lit(True)


def spans_by_kind(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, base and candidate spans as arrays of (start, rank, end, kind[, votes]); one pass over the text."""
    every = PATTERNS | PROPOSERS
    rows = pick(docs, doc_id, text).toDF("doc_id", "_text").select("doc_id", F.coalesce("_text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[_matches(F.col("text"), k, p, NEEDS.get(k)).alias(k) for k, p in every.items()])
    none = F.array().cast("array<struct<gap:int,size:int,body:string>>")
    rows = rows.select("doc_id", "text", *[F.when(F.size(k) > 0, _positions(F.col("text"), F.col(k), p)).otherwise(none).alias(k) for k, p in every.items()])
    rows = rows.select("doc_id", "text", *[_running(F.col(k)).alias(k) for k in every])

    def kept(k: str, rank: int) -> Column:
        good = F.filter(F.col(k), lambda x: _valid(k, x["body"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*[kept(k, i) for i, k in enumerate(BASE)])))

    rows = rows.select("doc_id", "text", "base", *[_apart(F.col(k), F.col("base")).alias(k) for k in ADDED])
    some = F.greatest(*[F.size(k) for k in ADDED]) > 0
    rows = rows.select("doc_id", "base", F.when(some, _blocks(F.col("text"))).alias("blocks"), *ADDED)

    def judged(k: str, rank: int) -> Column:
        def one(x: Column) -> Column:
            before = F.least(x["start"], F.lit(CONTEXT))
            left, right = F.lower(_cut(F.col("blocks"), x["start"] - before, before)), F.lower(_cut(F.col("blocks"), x["end"], F.lit(AFTER)))
            return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(k).alias("kind"), _votes(k, x["body"], left, right).alias("votes"))

        return F.transform(F.col(k), one)

    return rows.select("doc_id", "base", F.array_sort(F.concat(*[judged(k, len(BASE) + i) for i, k in enumerate(ADDED)])).alias("more"))


def _blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, so that a place is reached without a walk from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, size: Column) -> Column:
    """At most BLOCK code points from a place on."""
    at = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, at), F.lit("")), F.coalesce(F.get(blocks, at + 1), F.lit("")))
    return F.substring(two, start % BLOCK + 1, size)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from one place to another: the rest of a block, whole blocks, and the beginning of one."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    whole = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    far = F.concat(F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK)), whole, F.substring(block(last), F.lit(1), end % BLOCK))
    return F.when(first == last, F.substring(block(first), start % BLOCK + 1, end - start)).otherwise(far)


def _before(marks: Column, places: Column, ties: bool) -> Column:
    """For each of the rising places, how many marks come before it, or at it with ties: sorted together, an element's
    place less its own number."""
    tag = 1 if ties else 0
    both = F.array_sort(F.concat(F.transform(marks, lambda m: m.cast("long") * 2 + (1 - tag)), F.transform(places, lambda p: p.cast("long") * 2 + tag)))
    own = F.filter(F.transform(both, lambda v, i: F.struct((v % 2).alias("tag"), i.alias("i"))), lambda x: x["tag"] == tag)
    return F.transform(own, lambda x, j: x["i"] - j)


def _apart(found: Column, base: Column) -> Column:
    """The spans, in order and apart from each other, that overlap no base span: as many of these begin before a span's
    end as end by its start. Linear in both but for a sort."""
    begun = _before(F.transform(base, lambda b: b["start"]), F.transform(found, lambda x: x["end"]), False)
    ended = _before(F.transform(base, lambda b: b["end"]), F.transform(found, lambda x: x["start"]), True)
    free = F.zip_with(found, F.zip_with(begun, ended, lambda a, b: a == b), lambda x, f: F.struct(x.alias("x"), f.alias("f")))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(F.transform(F.filter(free, lambda y: y["f"]), lambda y: y["x"]))


def _mod97(body: Column) -> Column:
    """The remainder of an account number's check, letters counting from 10 and the first four characters last."""
    plain = F.regexp_replace(body, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4)), "")

    def step(s: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", s).when(code < 58, (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97)

    return F.aggregate(turned, F.lit(0), step)


def _checks(kind: str, body: Column) -> tuple[Column, Column, Column]:
    """The votes of the shape, checksum and gazetteer labelers."""
    none, given = F.lit("0"), "|".join(GIVEN)
    if kind == "secret":
        mixed = F.length(body).isin(32, 40, 64, 128) & body.rlike("[0-9]") & body.rlike("[A-Za-z]")
        spread = F.size(F.array_distinct(F.split(F.lower(body), "")))
        return F.when(mixed, "+").when(F.length(body) >= 24, "0").otherwise("-"), F.when(spread >= 11, "+").when(spread <= 6, "-").otherwise("0"), F.when(body.rlike("^(?:AKIA|gh[pousr]_|sk_|xox)"), "+").otherwise("0")
    if kind == "ssn":
        return F.when(body.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "+").otherwise("-"), none, F.when(body.isin("123-45-6789", "078-05-1120", "219-09-9999"), "0").otherwise("+")
    if kind == "iban":
        size = F.length(F.regexp_replace(body, " ", ""))
        known = F.element_at(F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv]), F.substring(body, 1, 2))
        return F.when(size.between(15, 34), "+").otherwise("-"), F.when(_mod97(body) == 1, "+").otherwise("-"), F.when(known == size, "+").when(known.isNull(), "0").otherwise("-")
    if kind == "local_phone":
        # Area and exchange codes start with 2 to 9, and neither is a service code such as 411.
        return F.when(body.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}"), "+").otherwise("-"), none, F.when(body.rlike(r"^\(?[0-9]11|[ .-][0-9]11[.-]"), "-").otherwise("+")
    if kind == "address":
        return F.when(body.rlike(r"^[1-9][0-9]{0,4} "), "+").otherwise("-"), none, F.when(body.rlike("(?:Street|Avenue|Road|Lane|Drive|Boulevard)$"), "+").otherwise("0")
    return F.when(body.rlike(rf"^(?:{_TITLES})\b.* .* |^(?!(?:{_TITLES})\b)"), "+").otherwise("0"), none, F.when(body.rlike(rf"(?:^| )(?:{given}) "), "+").otherwise("0")


def _votes(kind: str, body: Column, left: Column, right: Column) -> Column:
    """One sign for each of LABELERS: '+' for personal, '-' against, '0' for none. Each labeler looks at something of its own."""
    near, far, after = CUES[kind]
    word = lambda x: rf"(?:^|[^a-z])(?:{x})(?:[^a-z]|$)"
    close = F.substring(left, -NEAR, NEAR)
    votes = [
        *_checks(kind, body), F.when(close.rlike(word(near)), "+").otherwise("0"), F.when(left.rlike(word(far)), "+").otherwise("0"), F.when(right.rlike(word(after)), "+").otherwise("0"),
        F.when(left.rlike(r"[=:]\s*[\"']?$"), "+").otherwise("0"), F.when(left.rlike(r"[\"']$") & right.rlike(r"^[\"']"), "+").otherwise("0"),
        F.when(F.lower(body).rlike(word(COMMON)), "-").otherwise("0"), F.when(body.rlike(r"^(.)\1*$") | body.rlike(r"(.)\1{5}"), "-").otherwise("0"),
    ]
    return F.concat(*votes)


def _estimated(patterns: dict[tuple[str, str], int], posterior: dict[tuple[str, str], float], added: list[dict[str, tuple[float, float]]]) -> tuple[dict[tuple[str, str], float], list[dict[str, tuple[float, float]]]]:
    """EM from these posteriors on; added holds, for each labeler and vote, the counts that stand in for a prior."""
    posterior, tables = dict(posterior), []
    for _ in range(STEPS):
        tables = []
        for i in range(len(LABELERS)):
            mass = {s: list(added[i][s]) for s in "+-0"}
            for p, n in patterns.items():
                mass[p[1][i]][0] += n * posterior[p]
                mass[p[1][i]][1] += n * (1 - posterior[p])
            yes, no = (sum(m[j] for m in mass.values()) for j in (0, 1))
            tables.append({s: (m[0] / yes, m[1] / no) for s, m in mass.items()})
        priors = {}
        for kind in {k for k, _ in patterns}:
            own = [(n, posterior[k, v]) for (k, v), n in patterns.items() if k == kind]
            priors[kind] = (sum(n * q for n, q in own) + PRIOR) / (sum(n for n, _ in own) + 2 * PRIOR)
        for p in patterns:
            odds = math.log(priors[p[0]] / (1 - priors[p[0]])) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(tables, p[1]))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, tables


def reliabilities(patterns: dict[tuple[str, str], int]) -> tuple[dict[tuple[str, str], float], dict[str, list[dict[str, tuple[float, float]]]]]:
    """EM over vote patterns, {(kind, votes): count}: the posterior of each, and per kind and labeler P(vote | personal),
    P(vote | not). All kinds together come first; a kind's own estimates then start from these, which count as BORROWED
    candidates, so a kind with few candidates keeps close to the others."""
    start = {p: (1 + sum(v == "+" for v in p[1])) / (2 + sum(v != "0" for v in p[1])) for p in patterns}  # the vote's majority
    even = [{s: (PRIOR * (2.0 if s == "+" else 1.0), PRIOR * (2.0 if s == "-" else 1.0)) for s in "+-0"} for _ in LABELERS]
    shared, pooled = _estimated(patterns, start, even)
    posterior, tables = {}, {}
    for kind in sorted({k for k, _ in patterns}):
        own = {p: n for p, n in patterns.items() if p[0] == kind}
        some, tables[kind] = _estimated(own, {p: shared[p] for p in own}, [{s: (BORROWED * yes, BORROWED * no) for s, (yes, no) in t.items()} for t in pooled])
        posterior |= some
    return posterior, tables


def train_classifier(patterns: dict[tuple[str, str], int], posterior: dict[tuple[str, str], float], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic weights over 'bias', 'kind:<kind>' and '<labeler>:<vote>', fitted to the posteriors by gradient descent."""
    features = {p: ["bias", f"kind:{p[0]}", *[f"{name}:{v}" for name, v in zip(LABELERS, p[1])]] for p in patterns}
    weights = {f: 0.0 for fs in features.values() for f in fs}
    total = sum(patterns.values()) or 1
    for _ in range(steps):
        slope = {f: decay * w for f, w in weights.items()}
        for p, n in patterns.items():
            z = sum(weights[f] for f in features[p])
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - posterior[p]) * n / total
            for f in features[p]:
                slope[f] += miss
        for f in weights:
            weights[f] -= rate * slope[f]
    return weights


def _score(x: Column, weights: dict[str, float]) -> Column:
    """The classifier's log-odds as an expression over a candidate."""
    total = F.lit(weights.get("bias", 0.0))
    for kind in ADDED:
        total = total + F.when(x["kind"] == kind, weights.get(f"kind:{kind}", 0.0)).otherwise(0.0)
    for i, name in enumerate(LABELERS):
        vote = F.substring(x["votes"], i + 1, 1)
        total = total + F.when(vote == "+", weights.get(f"{name}:+", 0.0)).when(vote == "-", weights.get(f"{name}:-", 0.0)).otherwise(weights.get(f"{name}:0", 0.0))
    return total


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def judged_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans, and all spans: the base ones and the candidates that the trained classifier accepts."""
    rows = checkpointed(spans_by_kind(docs, doc_id, text))
    votes = rows.select(F.explode("more").alias("x")).groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = {(r["kind"], r["votes"]): r["n"] for r in votes.collect()}  # at most kinds * 3^labelers rows
    slim = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    if patterns:
        weights = train_classifier(patterns, reliabilities(patterns)[0])
        more = F.transform(F.filter("more", lambda x: _score(x, weights) > 0), slim)
        rows = rows.withColumn("spans", F.array_sort(F.concat("base", more)))
    else:
        rows = rows.withColumn("spans", F.col("base"))
    return rows.select("doc_id", "base", "spans")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = judged_spans(docs, doc_id, text)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def _first_spans(spans: Column) -> Column:
    """Of sorted spans those that begin where no earlier one of them still runs; RUN at a time."""
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def grow(s: Column, x: Column) -> Column:
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        return F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(span)).alias("out")))

    def chain(s: Column, r: Column) -> Column:
        done = F.aggregate(F.slice(spans, r * RUN + 1, F.lit(RUN)), F.struct(s["at"].alias("at"), nothing.alias("out")), grow)
        return F.struct(done["at"].alias("at"), F.concat(s["out"], done["out"]).alias("out"))

    runs = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int"))
    return F.when(F.size(spans) == 0, nothing).otherwise(F.aggregate(runs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), chain)["out"])


def mask_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with each span of its text replaced by its kind in brackets; of overlapping spans the first counts.

    Rows are written once with their candidates, so that no row needs to find its spans by an id; the classifier is
    trained on the votes of all of them, and the masking reads the table again.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    rows = checkpointed(spans_by_kind(packed, "_row", "_text").withColumnRenamed("doc_id", "_row"))
    votes = rows.select(F.explode("more").alias("x")).groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))
    patterns = {(r["kind"], r["votes"]): r["n"] for r in votes.collect()}  # bounded by kinds * 3^labelers
    weights = train_classifier(patterns, reliabilities(patterns)[0]) if patterns else {}
    slim = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    more = F.transform(F.filter("more", lambda x: _score(x, weights) > 0), slim) if patterns else F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    rows = rows.select("_row", _first_spans(F.array_sort(F.concat("base", more))).alias("spans"), F.col("_row")[text].alias("_text"))
    rows = rows.select("_row", "spans", "_text", F.when(F.size("spans") > 0, _blocks(F.col("_text"))).alias("blocks"))
    before = lambda i: F.coalesce(F.get(F.col("spans"), i - 1)["end"], F.lit(0))
    pieces = F.transform("spans", lambda x, i: F.concat(_between(F.col("blocks"), before(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = _between(F.col("blocks"), before(F.size("spans")), F.length("_text"))
    masked = F.when(F.size("spans") == 0, F.col("_text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    rows = rows.select("_row", masked.alias("_masked"))
    return rows.select(*[F.col("_masked").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
