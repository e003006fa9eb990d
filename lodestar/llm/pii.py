"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Everything on the way of a row is a DataFrame function. The driver sees counts of vote patterns, at most twice kinds times
3 to the number of labelers, and sums by feature: both bounded however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tables import Saved, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: What the contract's patterns match, in forms that neither recurse nor rescan long runs: possessive loops, and starts
#: within a run only where the match before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter runs fail the check anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be personal data beyond the base.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9-])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9-])",
    "phone": r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without this holds no match; for the patterns whose first character says little.
NEEDS = {"email": "@", "phone": "+"}
LOOSE_NEEDS = {"email": r"[(\[](?:at|AT)[)\]]", "ip": r"(?:[0-9A-Fa-f]{1,4}:){7}"}
#: Fixed words. Top-level domains; the networks' first digits and lengths; calling codes.
DOMAINS = "com org net edu gov mil int info biz name pro io co ai app dev cloud eu uk fr de es it nl be ch at pt pl cz sk hu ro bg gr se no fi dk ie is lt lv ee us ca mx br ar cl pe ve cn jp kr in au nz za ng ke eg tr ru ua il sa ae sg hk tw th vn id ph my pk".split()
NETWORKS = "4[0-9]{15}(?:[0-9]{3})?|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[013]|88[06]|96[0-8]|97[0-7]|99[2-8]"
#: What stands before a span of its kind, what before other numbers, and what after numbers that are nobody's.
BEFORE = {
    "email": r"mail|contact|write|courriel|correo|schreib|escrib|kontakt|écri",
    "ip": r"address|host|server|adresse|direcci|client|login|from|\bip\b",
    "card": r"card|visa|mastercard|amex|carte|karte|tarjeta|credit|payment",
    "phone": r"phone|call|\btel|fax|mobile|handy|llam|appel|anruf|\bring\b",
}
NOT_BEFORE = r"version|release|section|chapter|isbn|issn|\bdoi|token|serial|sha1|md5|uuid|hash|order|invoice|part no|item|figure|page"
AFTER = r"^\W{0,3}(?:thanks|anytime|mobile|office|ext\b|work|home|any time)"
NOT_AFTER = r"^\W{0,2}(?:units?|px|kg|km|ms|mm|usd|eur|pages?|items?|pieces|pcs|bytes|%|€|\$)"
#: Code points before and after a span in which words are sought, and between spans of two kinds that keep company.
CONTEXT, COMPANY = 32, 120
VOTERS = ("form", "gazetteer", "before", "after", "edges", "shape", "company")
ROUNDS = 40
#: A loose span becomes a span at this probability.
ACCEPT = 0.9
#: Matches that a text's positions are summed over at once.
FOLD = 256
#: The classifier's features by number: a vote for or against by voter, the words before and after by hash, the length, the classes of the first and last character, what separates digits.
WORDS, LENGTHS, SEPARATORS = 64, 32, 16
_AT = {"votes": 0, "prev": 2 * len(VOTERS)}
_AT["next"] = _AT["prev"] + WORDS
_AT["length"] = _AT["next"] + WORDS
_AT["first"] = _AT["length"] + LENGTHS
_AT["last"] = _AT["first"] + 4
_AT["separators"] = _AT["last"] + 4
FEATURES = _AT["separators"] + SEPARATORS
#: Rows that a feature's prior share is worth.
PSEUDO = 4.0
#: Loose matches that are real, to begin with, and how often a labeler votes for one that isn't; as many rows as each is worth.
LOOSE_SHARE, LOOSE_ROWS = 0.3, 10.0
LOOSE_OTHER = {"form": 0.5, "gazetteer": 0.5, "before": 0.05, "after": 0.2, "edges": 0.6, "shape": 0.7, "company": 0.5}
#: A loose match after a word for numbers of another sort is real at most this probably.
AGAINST = 0.02


def _found(text: Column, kind: int, pattern: str, base: bool, needs: Column) -> Column:
    """Array of (start, kind, base, end, value) of the pattern's matches, in code points.

    Positions are running sums of what stands between and in matches: within FOLD matches, then over their sums.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,kind:int,base:boolean,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / FOLD).cast("int")), lambda b: F.slice(pairs, b * FOLD + 1, F.lit(FOLD)))
    long_ = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.char_length(x["gap"]) + F.char_length(x["hit"])))
    begins = F.aggregate(long_, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    listed = F.flatten(F.zip_with(parts, begins, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))
    return F.when(needs & text.rlike(pattern), listed).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.char_length(bare) <= 3) & (F.concat(F.lit("0"), F.substring(bare, 1, 3)).cast("int") <= 255)


def passes(kind: Column, value: Column) -> Column:
    """The checks that the base asks for after the pattern."""
    d = _digits(value)
    n = F.char_length(d)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, F.forall(F.split(value, r"\."), _small))
        .when(kind == 2, n.between(14, 19) & _luhn(d))
        .otherwise(n.between(10, 15))
    )


def _votes(kind: Column, value: Column) -> dict[str, Column]:
    """What each labeler says of a span: 1 for, 0 against, -1 nothing."""
    say = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else ~yes, 0).otherwise(-1)
    digits, lower = _digits(value), F.lower(value)
    local, last = F.regexp_extract(value, r"^[^@(\[\x20]+", 0), F.regexp_extract(lower, "([a-z0-9-]+)$", 1)
    v6 = value.contains(":")
    octet = lambda k: F.substring(F.regexp_extract(value, rf"^(?:[0-9]+\.){{{k}}}([0-9]+)", 1), 1, 9).cast("int")
    hidden = octet(0).isin(0, 10, 127) | (octet(0) >= 224) | ((octet(0) == 192) & (octet(1) == 168)) | ((octet(0) == 172) & octet(1).between(16, 31)) | ((octet(0) == 169) & (octet(1) == 254))
    called = value.startswith("+") | value.startswith("00")
    number = F.regexp_replace(digits, "^0+", "")
    american = (value.startswith("+1") | ~called) & F.char_length(number).isin(10, 11)
    form = (
        F.when(kind == 0, say(~local.rlike(r"^\.|\.$|\.\.") & ~value.rlike(r"[@.]-|-(?:\.|$)")))
        .when(kind == 1, F.when(v6, -1).otherwise(say(~value.rlike(r"(?:^|\.)0[0-9]"))))
        .when(kind == 2, say(F.char_length(digits).between(14, 19) & _luhn(digits)))
        .otherwise(F.when(american, say(number.rlike("^1?[2-9][0-9]{2}[2-9]"))).otherwise(-1))
    )
    gazetteer = (
        F.when(kind == 0, say(last.isin(*DOMAINS)))
        .when(kind == 1, F.when(v6, say(lower.rlike("^[23]"), lower.rlike("^f[cde]"))).otherwise(say(~hidden)))
        .when(kind == 2, say(digits.rlike(f"^(?:{NETWORKS})$")))
        .otherwise(F.when(called, say(number.rlike(f"^(?:{CALLING})"))).otherwise(-1))
    )
    own, other = F.lit(False), F.lit(False)
    for k, x in enumerate(KINDS):
        own, other = own | ((kind == k) & F.col("before").rlike(BEFORE[x])), other | ((kind != k) & F.col("before").rlike(rf"(?:{BEFORE[x]})\W*$"))
    before = say(own & ~F.col("before").rlike(NOT_BEFORE), F.col("before").rlike(NOT_BEFORE) | other)
    after = say(F.col("after").rlike(AFTER), F.col("after").rlike(NOT_AFTER))
    edges = say(~F.concat(F.substring(F.concat(F.lit(" "), "before"), -1, 1), F.substring(F.col("after"), 1, 1)).rlike(r"[A-Za-z0-9_@]"))
    plain = F.when(kind == 0, ~F.lower(local).rlike("^(?:no-?reply|test|example|user|name|[0-9]+)$") & (F.char_length(last) >= 2)).otherwise(~digits.rlike("^(.)\\1+$|01234567|12345678|98765432|00000"))
    company = F.when(F.col("near_other"), 1).otherwise(-1)
    return dict(zip(VOTERS, (form, gazetteer, before, after, edges, say(plain), company), strict=True))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, base, start, end, a vote 1, 0 or -1 (abstains) for each of VOTERS, features) by span.

    Loose matches beside a base span that they overlap aren't listed.
    """
    text = text_or_empty(text_col)
    needs = lambda x: F.col("text").contains(NEEDS[x]) if x in NEEDS else F.lit(True)
    loose = lambda x: F.col("text").rlike(LOOSE_NEEDS[x]) if x in LOOSE_NEEDS else F.lit(True)
    spans = F.concat(*[_found(F.col("text"), k, BASE[x], True, needs(x)) for k, x in enumerate(KINDS)], *[_found(F.col("text"), k, LOOSE[x], False, loose(x)) for k, x in enumerate(KINDS)])
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = rows.withColumn("spans", spans).where(F.size("spans") > 0)
    rows = rows.withColumn("spans", F.array_sort(F.filter("spans", lambda s: ~s["base"] | passes(s["kind"], s["value"]))))
    side = lambda i, d: F.get("spans", i + d)
    beside = lambda s, o, far: (o["start"] < s["end"] + far) & (s["start"] < o["end"] + far)
    near = lambda s, i: F.coalesce(*[F.when((side(i, d)["kind"] != s["kind"]) & beside(s, side(i, d), COMPANY), True) for d in (-1, 1)], F.lit(False))
    within = lambda s, i: F.coalesce(*[F.when(~s["base"] & side(i, d)["base"] & beside(s, side(i, d), 0), True) for d in (-1, 1)], F.lit(False))
    before = lambda s: F.lower(F.substring("text", F.greatest(F.lit(1), s["start"] - CONTEXT + 1), F.least(s["start"], F.lit(CONTEXT))))
    after = lambda s: F.lower(F.substring("text", s["end"] + 1, F.lit(CONTEXT)))
    told = F.transform("spans", lambda s, i: F.struct(s["kind"].alias("kind"), s["base"].alias("base"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), before(s).alias("before"), after(s).alias("after"), near(s, i).alias("near_other"), within(s, i).alias("within")))
    rows = rows.select("doc_id", "text_hash", F.explode(told).alias("s")).select("doc_id", "text_hash", "s.*").where("not within")
    kind, value = F.col("kind"), F.col("value")
    rows = rows.withColumns({k: v.cast("int") for k, v in _votes(kind, value).items()})
    hashed = lambda word: F.pmod(F.xxhash64(word), F.lit(WORDS)).cast("int")
    sort = lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Za-z]"), 1).when(c.rlike(r"[(\[+]"), 2).otherwise(3)
    marks = sum((F.when(value.contains(c), 1 << k).otherwise(0) for k, c in enumerate((" ", "-", ".", "("))), F.lit(0))
    features = F.array(
        *[F.when(F.col(v) >= 0, 2 * k + F.col(v)) for k, v in enumerate(VOTERS)],
        F.lit(_AT["prev"]) + hashed(F.regexp_extract("before", r"(\w+)\W*$", 1)),
        F.lit(_AT["next"]) + hashed(F.regexp_extract("after", r"^\W*(\w+)", 1)),
        F.lit(_AT["length"]) + F.least(F.char_length(value), F.lit(LENGTHS - 1)),
        F.lit(_AT["first"]) + sort(F.substring(value, 1, 1)),
        F.lit(_AT["last"]) + sort(F.substring(value, -1, 1)),
        F.lit(_AT["separators"]) + marks,
    )
    return rows.select("doc_id", "text_hash", "kind", "base", "start", "end", *VOTERS, F.array_compact(features).alias("features"))


Pattern = tuple[int, tuple[int, ...], int]


def reliabilities(patterns: list[Pattern]) -> tuple[dict[int, float], dict[int, list[tuple[float, float]]], dict[tuple[int, tuple[int, ...]], float]]:
    """Expectation-maximisation of a two-coin model over (kind, votes, count): by kind the share of real spans and each labeler's reliability, and each pattern's probability.

    A labeler has two: how often it votes for a real span, and for another. One that says yes to nearly all has them alike, and weighs nothing.
    """
    share = {k: 0.7 for k in range(len(KINDS))}
    coins = {k: [(0.85, 0.3) for _ in VOTERS] for k in range(len(KINDS))}
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(ROUNDS):
        for kind, votes, _n in patterns:
            log = math.log(share[kind]) - math.log(1 - share[kind])
            for v, (a, b) in zip(votes, coins[kind], strict=True):
                if v >= 0:
                    log += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            post[kind, votes] = 1 / (1 + math.exp(-max(-40.0, min(40.0, log))))
        for kind in share:
            own = [(v, n * post[kind, v], n * (1 - post[kind, v])) for k, v, n in patterns if k == kind]
            # pseudo-counts keep what few votes say from certainty
            share[kind] = (sum(y for _, y, _ in own) + 7) / (sum(y + n for _, y, n in own) + 10)
            for j in range(len(VOTERS)):
                cast = [(v[j], y, n) for v, y, n in own if v[j] >= 0]
                a = (sum(y for v, y, _ in cast if v) + 8.5) / (sum(y for _, y, _ in cast) + 10)
                b = (sum(n for v, _, n in cast if v) + 3) / (sum(n for _, _, n in cast) + 10)
                coins[kind][j] = (min(0.99, max(a, b, 0.02)), max(0.01, min(b, 0.98)))
    return share, coins, post


Coins = dict[int, list[tuple[float, float]]]


def loose_reliabilities(patterns: list[Pattern], base: Coins) -> tuple[dict[int, float], Coins, dict[tuple[int, tuple[int, ...]], float]]:
    """As reliabilities(), of loose matches alone: they have a share and coins of their own, so base spans, nearly all real, don't vouch for them.

    What base spans do tell is how labelers vote on real ones. Where there are few loose matches the estimates stay
    near LOOSE_SHARE and LOOSE_OTHER; a word that speaks against one is an anchor.
    """
    share = dict.fromkeys(range(len(KINDS)), LOOSE_SHARE)
    first = {k: [(min(0.98, max(0.8, a)), LOOSE_OTHER[v]) for v, (a, _) in zip(VOTERS, base[k], strict=True)] for k in share}
    coins, word = {k: list(x) for k, x in first.items()}, VOTERS.index("before")
    post: dict[tuple[int, tuple[int, ...]], float] = {}
    for _ in range(ROUNDS):
        for kind, votes, _n in patterns:
            log = math.log(share[kind] / (1 - share[kind]))
            for v, (a, b) in zip(votes, coins[kind], strict=True):
                if v >= 0:
                    log += math.log(a / b) if v else math.log((1 - a) / (1 - b))
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, log))))
            post[kind, votes] = min(p, AGAINST) if votes[word] == 0 else p
        for kind in share:
            own = [(v, n * post[kind, v], n * (1 - post[kind, v])) for k, v, n in patterns if k == kind]
            share[kind] = (sum(y for _, y, _ in own) + LOOSE_ROWS * LOOSE_SHARE) / (sum(y + n for _, y, n in own) + LOOSE_ROWS)
            for j, (a0, b0) in enumerate(first[kind]):
                cast = [(v[j], y, n) for v, y, n in own if v[j] >= 0]
                a = (sum(y for v, y, _ in cast if v) + LOOSE_ROWS * a0) / (sum(y for _, y, _ in cast) + LOOSE_ROWS)
                b = (sum(n for v, _, n in cast if v) + LOOSE_ROWS * b0) / (sum(n for _, _, n in cast) + LOOSE_ROWS)
                coins[kind][j] = (min(0.98, max(a, b)), max(0.02, min(b, 0.97)))
    return share, coins, post


def loose_classifier(rows: DataFrame, share: dict[int, float], coins: Coins, post: dict[tuple[int, tuple[int, ...]], float]) -> list[tuple[float, list[float]]]:
    """span_classifier() on loose rows, with the odds of their own share and, for votes, the weights of their coins."""
    out = []
    for k, (_, weight) in enumerate(span_classifier(rows, post)):
        votes = [x for a, b in coins[k] for x in (math.log((1 - a) / (1 - b)), math.log(a / b))]
        out.append((math.log(share[k] / (1 - share[k])), votes + weight[2 * len(VOTERS) :]))
    return out


def span_classifier(rows: DataFrame, post: dict[tuple[int, tuple[int, ...]], float]) -> list[tuple[float, list[float]]]:
    """Naive Bayes on the features of spans, trained on the labels' probabilities: by kind a bias and a weight for each of FEATURES.

    A weight is how far the odds among spans with a feature are from the kind's, PSEUDO rows of which it is worth more.
    Sums are Spark aggregates: the driver sees at most kinds times FEATURES of them.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, *v, p) for (k, v), p in post.items()], "kind int, " + ", ".join(f"{v} int" for v in VOTERS) + ", p double")
    likely = rows.join(F.broadcast(known), ["kind", *VOTERS])
    sums = likely.select("kind", "p", F.explode(F.concat("features", F.array(F.lit(FEATURES)))).alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    found = {(r["kind"], r["f"]): (r["yes"], r["no"]) for r in sums}
    out = []
    for k in range(len(KINDS)):
        yes, no = found.get((k, FEATURES), (0.0, 0.0))
        share = (yes + 1) / (yes + no + 2)
        odds = math.log(share / (1 - share))
        weight = []
        for f in range(FEATURES):
            y, n = found.get((k, f), (0.0, 0.0))
            weight.append(math.log((y + PSEUDO * share) / (n + PSEUDO * (1 - share))) - odds)
        out.append((odds, weight))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, n_spans, base, spans), one row for each input row.

    The counts by kind are of base spans, n_spans of all; `base` and `spans` are lists kind:start:end in order of start, then kind, offsets in
    code points and ends exclusive. `spans` has the base, and of the loose candidates that touch no base span of their
    kind those to which the classifier gives ACCEPT or more. A null text is empty; a null id is carried along; rows
    that repeat id and text get equal results; an empty table gives none.
    """
    saved = Saved(docs.sparkSession)
    rows = saved.save(candidates(docs, id_col, text_col))
    found = rows.groupBy("base", "kind", *VOTERS).agg(F.count("*").alias("n")).collect()
    patterns = lambda base: [(r["kind"], tuple(r[v] for v in VOTERS), r["n"]) for r in found if r["base"] == base]
    _, base_coins, _ = reliabilities(patterns(True))
    share, coins, post = loose_reliabilities(patterns(False), base_coins)
    model = loose_classifier(rows.where("not base"), share, coins, post) if post else [(0.0, [0.0] * FEATURES)] * len(KINDS)
    weights = F.element_at(F.array(*[F.lit(list(map(float, w))) for _, w in model]), F.col("kind") + 1)
    bias = F.element_at(F.lit([float(b) for b, _ in model]), F.col("kind") + 1)
    z = F.aggregate("features", bias, lambda z, f: z + F.get(weights, f))
    likely = 1 / (1 + F.exp(-z)) >= ACCEPT
    kept = rows.where(F.col("base") | likely)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", "end", "base", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    by_doc = kept.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    free = lambda x: ~F.exists("base_spans", lambda y: (y["kind"] == x["kind"]) & (y["start"] < x["end"]) & (x["start"] < y["end"]))
    by_doc = by_doc.withColumn("base_spans", base).withColumn("all_spans", F.filter("s", lambda x: x["base"] | free(x)))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"))
    b = by_doc.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "base_spans", "all_spans")
    out = ids.join(b, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    count = lambda k: F.coalesce(F.size(F.filter("base_spans", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    said = lambda c: F.coalesce(F.concat_ws(",", F.transform(c, lambda x: x["said"])), F.lit(""))
    many = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select(
        "doc_id",
        *[F.when(F.col("base_spans").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{x}") for k, x in enumerate(KINDS)],
        F.when(F.col("base_spans").isNull(), F.lit(0).cast("long")).otherwise((many("all_spans") - many("base_spans")).cast("long")).alias("n_added"),
        F.when(F.col("base_spans").isNull(), F.lit(0).cast("long")).otherwise(many("all_spans").cast("long")).alias("n_spans"),
        said("base_spans").alias("base"),
        said("all_spans").alias("spans"),
    )
