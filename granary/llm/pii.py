r"""Personal data by weak supervision, with DataFrame functions only.

Four base kinds (email, ip, card, phone) have exact patterns. Beyond them, loose patterns propose
candidates: token-like strings, numbers and written-out addresses. Five labelers vote on each (for,
against, or not at all): the base patterns, the candidate's shape, gazetteers, the words before it and
the characters around it. The votes of all candidates of the corpus are counted by pattern, and
expectation-maximisation over the counts estimates how reliable each labeler is and how likely each
pattern is personal data. These probabilities train the final classifier, a logistic regression on
the votes and on classes of shape; its weights become one more column expression. The driver only
ever holds counts by pattern and class, whose number has a fixed bound. Texts are searched once: their
matches are written, and both the training and the result read them.

Base spans are always kept; a candidate that the classifier accepts is added where it overlaps none.
Positions are code points, ends exclusive. A text's matches are found by ``regexp_extract_all`` and the
pieces between them by ``split`` with the same pattern; the lengths add up to positions. The patterns
are possessive or anchored to the start of a run, which finds the same matches in linear time and
without recursion on very long texts.

Defined results: a null text is empty and has no spans; repeated rows have equal answers and all
count in training; a corpus without candidates adds none; an empty table gives an empty result; other
columns pass through ``redact``, names that begin with ``__`` are reserved.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialise, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "number", "contact")

#: Base patterns, with a cheap test that a text with a match passes. An address may begin inside a run
#: of its characters only where the last match ended (``\G``); elsewhere the run's start is as good.
PATTERNS = {
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"),
    ),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9]")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]")),
}
#: Candidates: written-out addresses, token-like strings with a digit and a letter, numbers of seven digits
#: or more. All end where the run of their characters does, however long it is.
CANDIDATES = (
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+"
    r"|(?<![A-Za-z0-9.])(?=[0-9](?:[ ().-]{0,2}[0-9]){6}[0-9]*+(?![A-Za-z]))[0-9]++(?:[ ().-]{1,2}[0-9]++(?![A-Za-z]))*+"
)
CONTEXT_CHARS = 24
RUN = 64
#: Fixed lists of the gazetteers and of the context labeler.
KEY_PREFIXES = (
    "AKIA", "ASIA", "AIza", "EAA", "SK", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "hf_", "npm_", "pypi-", "dop_v1_", "shpat_",
    "sk-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "whsec_", "xapp-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "ya29", "eyJ",
)
TOP_DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "co", "me", "app", "dev", "eu",
    "ar", "at", "au", "be", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "es", "fi", "fr", "gr", "hu", "ie", "in", "it", "jp", "kr", "mx",
    "nl", "no", "nz", "pe", "pl", "pt", "ro", "ru", "se", "tr", "ua", "uk", "us", "za",
)
BOOK_PREFIXES = ("978", "979")
FOR_WORDS = (
    "password", "passwd", "pwd", "secret", "token", "key", "api", "bearer", "login", "tel", "phone", "call", "fax",
    "mobile", "ssn", "card", "iban", "account", "mail", "contact", "passport", "id",
)
AGAINST_WORDS = ("version", "isbn", "issn", "page", "pages", "vol", "volume", "figure", "year", "line", "chapter", "section", "commit", "build")
LABELERS = ("base", "shape", "gazetteer", "context", "around")
EM_ROUNDS, FIT_ROUNDS, FIT_RATE, DECAY = 50, 400, 0.5, 1e-3

_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda, a column expression is computed anew
    for each element, but a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _placed(found: Column, gaps: Column) -> Column:
    """The spans of the matches found between the gaps. Starts are sums of the sizes before: those of
    whole runs of RUN matches, and those of the same run, so that the work stays near linear."""
    sizes = F.transform(found, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))
    last_run = F.floor((F.size(found) - 1) / RUN).cast("int")

    def with_runs(size: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), last_run), lambda r: _total(F.slice(size, r * RUN + 1, F.lit(RUN))))
        return _let(runs, lambda total: with_bases(size, total))

    def with_bases(size: Column, total: Column) -> Column:
        bases = F.transform(total, lambda _, r: _total(F.slice(total, F.lit(1), r)))
        return _let(bases, lambda base: F.transform(found, lambda x, i: span(size, base, x, i)))

    def span(size: Column, base: Column, x: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        start = F.length(before) + F.get(base, run) + _total(F.slice(size, run * RUN + 1, i - run * RUN))
        return _let(start, lambda at: F.struct(
            at.alias("start"), (at + F.length(x)).alias("end"), x.alias("value"),
            F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), F.left(after, F.lit(CONTEXT_CHARS)).alias("after"),
        ))

    return _let(sizes, with_runs)


def spans(text: Column, pattern: str, likely: Column) -> Column:
    """All matches, in order: array of (start, end, value, before, after)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{_SPAN}>")
    gaps = F.split(text, pattern, -1)
    placed = _let(found, lambda m: F.when(F.size(m) > 0, _let(gaps, lambda g: _placed(m, g))).otherwise(none))
    return F.when(likely, placed).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        small = lambda p: F.coalesce(F.regexp_replace(p, r"\A0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255
        return F.forall(F.split(value, r"\."), small)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a span array __email, __ip, __card, __phone, and the candidates __more."""
    text = F.col("__text")
    rows = docs.withColumn("__text", text_or_empty(text_col))
    for kind, (pattern, likely) in PATTERNS.items():
        rows = rows.withColumn(f"__{kind}", F.filter(spans(text, pattern, likely(text)), partial(_valid, kind)))
    likely = text.rlike("[0-9]|[(\\[]at[)\\]]")
    return rows.withColumn("__more", spans(text, CANDIDATES, likely))


def _overlaps(s: Column, kinds=BASE_KINDS) -> Column:
    one = lambda k: F.exists(F.col(f"__{k}"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return reduce(lambda a, b: a | b, map(one, kinds))


def _words(words, before: str = r"(?<![A-Za-z])") -> str:
    return rf"(?i){before}(?:{'|'.join(words)})[^A-Za-z0-9]{{0,6}}\z"


def _kind(value: Column) -> Column:
    return (
        F.when(value.rlike(r"[(\[]at[)\]]"), "contact").when(value.rlike("[A-Za-z]"), "secret").otherwise("number")
    )


def _is_kind(kind: str, s: Column) -> Column:
    return _kind(s["value"]) == kind


def _votes(s: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1, -1 or 0."""
    value, before, after = s["value"], s["before"], s["after"]
    kind, digits = _kind(value), _digits(value)
    starts = lambda words: reduce(lambda a, b: a | b, [value.startswith(w) for w in words])
    letter, digit = "[^A-Za-z]*+[A-Za-z]", "[^0-9]*+[0-9]"
    mixed = value.rlike(rf"\A(?:{letter}{digit}{letter}|{digit}{letter}{digit})") & (F.length(digits) >= 3) & (F.length(value) >= 16)
    phone = value.rlike(r"\A(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}\z|\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z")
    card = F.length(digits) >= 13  # or several in a row
    date = value.rlike(r"\A(?:19|20)[0-9]{2}[-. ][01]?[0-9][-. ][0-3]?[0-9]\z|\A[0-3]?[0-9][-. ][01]?[0-9][-. ](?:19|20)[0-9]{2}\z")
    flat = digits.rlike(r"\A([0-9])\1*\z")
    shape = (
        F.when(kind == "contact", 1)
        .when(kind == "secret", F.when(mixed, 1).when(value.rlike(r"\A[A-Za-z]+[-/_][0-9]{1,4}\z"), -1).otherwise(0))
        .otherwise(F.when(date | flat, -1).when(phone | card, 1).otherwise(0))
    )
    domain = value.rlike(rf"(?:\.|dot[)\]]) ?(?:{'|'.join(TOP_DOMAINS)})\z")
    gazetteer = (
        F.when((kind == "contact") & domain, 1)
        .when((kind == "secret") & starts(KEY_PREFIXES), 1)
        .when((kind == "number") & starts(BOOK_PREFIXES), -1)
        .otherwise(0)
    )
    context = F.when(before.rlike(_words(FOR_WORDS)), 1).when(before.rlike(_words(AGAINST_WORDS)), -1).otherwise(0)
    around = (
        F.when(before.rlike(r"""[=:]\s?["']?\z"""), 1)
        .when(before.rlike(r"[/#.$]\z") | after.rlike(r"\A[/%$]"), -1)
        .otherwise(0)
    )
    base = F.when(_overlaps(s), 1).otherwise(0)
    return {"base": base, "shape": shape, "gazetteer": gazetteer, "context": context, "around": around}


def _classes(s: Column) -> dict[str, Column]:
    """Classes of a candidate's shape, each with few values."""
    value = s["value"]
    size, digits = F.length(value), F.length(_digits(value))
    share = F.when(digits == size, "all").when(digits * 2 >= size, "half").otherwise("few")
    length = F.when(size < 12, "s").when(size < 20, "m").when(size < 40, "l").otherwise("x")
    return {"kind": _kind(value), "length": length, "digits": share}


def _features(s: Column) -> list[Column]:
    """The classifier's features as names; the base patterns' vote is left out, as what it accepts is
    kept anyway."""
    named = {k: v for k, v in _votes(s).items() if k != "base"} | _classes(s)
    return [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in named.items()]


def _em(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """How likely each pattern of votes is personal data: two classes, and for each a probability of
    each vote of each labeler, starting from the majority of votes."""
    likely = {p: (sum(v > 0 for v in p) + 0.5) / (sum(v != 0 for v in p) + 1) for p in counts}
    total = sum(counts.values())
    for _ in range(EM_ROUNDS):
        prior = (sum(counts[p] * likely[p] for p in counts) + 1) / (total + 2)
        rates = []
        for j in range(len(LABELERS)):
            sums = {(c, v): 1.0 for c in (0, 1) for v in (-1, 0, 1)}
            for p, n in counts.items():
                sums[1, p[j]] += n * likely[p]
                sums[0, p[j]] += n * (1 - likely[p])
            of = {c: sum(sums[c, v] for v in (-1, 0, 1)) for c in (0, 1)}
            rates.append({k: x / of[k[0]] for k, x in sums.items()})
        after = {}
        for p in counts:
            z = math.log(prior / (1 - prior)) + sum(math.log(rates[j][1, v] / rates[j][0, v]) for j, v in enumerate(p))
            after[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        likely = after
    return likely


def fit(rows: DataFrame) -> dict[str, float]:
    """Weights of the classifier's features, from all candidates of rows (made by ``with_spans``)."""
    one = F.struct(
        F.array(*[_votes(F.col("s"))[k].cast("int") for k in LABELERS]).alias("votes"), F.array(*_features(F.col("s"))).alias("features")
    )
    seen = rows.select(*[f"__{k}" for k in BASE_KINDS], F.explode("__more").alias("s")).select(one.alias("x"))
    # At most 3 ** 5 patterns of votes times 36 classes of shape.
    found = [(tuple(r.votes), tuple(r.features), r.n) for r in seen.groupBy("x.votes", "x.features").agg(F.count(F.lit(1)).alias("n")).collect()]
    found.sort()
    if not found:
        return {}
    counts: dict[tuple[int, ...], int] = defaultdict(int)
    for votes, _, n in found:
        counts[votes] += n
    likely = _em(counts)
    weights: dict[str, float] = defaultdict(float)
    total = sum(n for *_, n in found)
    for _ in range(FIT_ROUNDS):
        step: dict[str, float] = defaultdict(float)
        for votes, features, n in found:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, weights["bias"] + sum(weights[f] for f in features)))))
            for f in (*features, "bias"):
                step[f] += n * (likely[votes] - p) / total
        for f, g in step.items():
            weights[f] += FIT_RATE * (g - DECAY * weights[f])
    return dict(weights)


def with_accepted(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with __secret, __number and __contact: the candidates that the classifier accepts and that
    overlap no base span."""
    def accepted(s: Column) -> Column:
        if not weights:
            return F.lit(False)
        score = F.lit(weights.get("bias", 0.0))
        table = F.create_map(*[F.lit(x) for f, w in sorted(weights.items()) for x in (f, w)])
        for f in _features(s):
            score = score + F.coalesce(F.try_element_at(table, f), F.lit(0.0))
        return (score > 0) & ~_overlaps(s)

    rows = rows.withColumn("__more", F.filter("__more", accepted))
    for kind in MORE_KINDS:
        rows = rows.withColumn(f"__{kind}", F.filter("__more", partial(_is_kind, kind)))
    return rows


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns keep, with seven span arrays, __email to __contact; see ``with_spans`` for
    their fields."""
    found = with_spans(docs, text_col).select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)], *[f"__{k}" for k in BASE_KINDS], "__more")
    rows = materialise(found, "spans")
    return with_accepted(rows, fit(rows))


def listing(kinds) -> Column:
    """kind:start:end of all spans, by kind, then start."""
    def place(kind: str, s: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))

    each = [F.transform(f"__{k}", partial(place, k)) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one, of
    the first one's kind. Null texts stay null."""
    def tag(kind: str, s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    tagged = F.array_sort(F.concat(*[F.transform(f"__{k}", partial(tag, k)) for k in (*BASE_KINDS, *MORE_KINDS)]))
    kind = "struct<start:int,end:int,kind:string>"

    def join(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        meets = (F.size(out) > 0) & (s["start"] < last["end"])
        return F.when(meets, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(both))).otherwise(F.concat(out, F.array(s)))

    merged = F.aggregate("__tagged", F.array().cast(f"array<{kind}>"), join)
    text = text_or_empty(text_col)

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(F.col("__merged"), F.when(i > 0, i).otherwise(1))["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, before + 1, s["start"] - before), F.lit("<"), F.upper(s["kind"]), F.lit(">"))

    tail = F.substring(text, F.element_at(F.col("__merged"), -1)["end"] + 1, F.length(text))
    clean = F.concat(F.array_join(F.transform(F.col("__merged"), piece), ""), tail)
    rows = find(docs, text_col).withColumn("__tagged", tagged).withColumn("__merged", merged)
    made = F.when(F.size("__merged") > 0, clean).otherwise(F.col(text_col).cast("string"))
    return rows.withColumn("__clean", made).select(*[F.col("__clean").alias(c) if c == text_col else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, keep=["doc_id"]).select(
        "doc_id",
        *[F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listing(BASE_KINDS), 256).alias("base_sha256"),
        listing((*BASE_KINDS, *MORE_KINDS)).alias("spans"),
    )
