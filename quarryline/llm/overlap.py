"""The same or nearly the same question in training and evaluation splits (p1).

A question is reduced to the thing it names and the words it says about it; spelling slips are mended against the corpus's own
frequent words. What may name a thing written as plain words is learnt from the corpus: words that mostly stand inside code
identifiers. Both parts make one 128-bit similarity hash in which the name weighs most. Equal questions collapse into classes
first, so copies are never paired with each other. Codes of classes are cut into ``SEGMENTS`` blocks; classes of different
splits whose blocks are equal, or one bit apart, in one place are joined and kept within ``RADIUS`` bits, then their texts are
compared: no pair within the radius is missed. A block that very many classes share is split further by the words of the
questions, which loses no match. Members are expanded only for classes that match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import cut, first_delivery

TRAIN, EVALUATION = ("train",), ("validation", "test")
SEGMENTS, BITS, RADIUS = 8, 16, 14
LENIENT = RADIUS + 1 - SEGMENTS  # blocks that may differ in one bit
NAME_WEIGHT = 8.0
LEAST = 0.6  # of the words of the shorter question must stand in the other
HOT = 1 << 20  # comparisons in one block beyond which its pairs must share a word too

# Letters of other scripts that look like Latin ones, and the Latin ones.
LOOKALIKES = dict(zip("аеорсухіѕԁјӏһԛԝαορνικ", "aeopcyxisdjlhqwaopvik", strict=False))
# Words that carry no content of a question.
PLAIN_WORDS = frozenset(
    "a about all also am an and any are as at be been but by can could did do does for from has have hello hi how i if in into is it its"
    " me my no nor not of on or our out over please should so than thank thanks that the their them then there these they this those"
    " to under up us was we were what when whenever where whether which while who why will with would you your".split()
)
# Adverbs that change nothing.
FILLERS = frozenset("actually again apparently basically currently exactly just now perhaps possibly really simply still usually".split())

_TOKEN = re.compile(r"[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


def folded(text: str) -> str:
    return _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).translate(str.maketrans(LOOKALIKES))


def tokens(text: str | None) -> list[list[str]]:
    """The text's words in order, each as the list of its parts; a code identifier has several parts."""
    if not text:
        return []
    found = []
    for token in _TOKEN.findall(folded(text)):
        parts = [p.lower() for p in _HUMPS.split(token) if p]
        if token.isupper() and "_" not in token:
            parts = [token.lower()]
        if parts:
            found.append(parts)
    return found


@F.pandas_udf(T.StringType())
def _tokenised(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join("_".join(p) for p in tokens(t)))


class Speller:
    """Mends words that are one slip away from a frequent word, and cuts run-together identifiers into frequent words."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent, self.memo = frequent, {}
        self.near: dict[str, list[str]] = {}
        for word in frequent:
            if len(word) >= 4 and word.isalpha():
                for key in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
                    self.near.setdefault(key, []).append(word)

    def mend(self, word: str) -> str:
        if word in self.frequent or len(word) < 3 or not word.isalpha():
            return word
        if word not in self.memo:
            keys = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
            near = {w for k in keys for w in self.near.get(k, ()) if _one_slip(word, w)}
            self.memo[word] = max(near, key=lambda w: (self.frequent[w], w)) if near else word
        return self.memo[word]

    def cut(self, word: str) -> list[str]:
        """The fewest frequent words that make up ``word``, else the word itself."""
        if len(word) < 12 or word in self.frequent or not word.isalpha():
            return [word]
        best: list[list[str] | None] = [[]] + [None] * len(word)
        for end in range(3, len(word) + 1):
            for start in range(max(0, end - 14), end - 2):
                head = best[start]
                if head is not None and word[start:end] in self.frequent and (best[end] is None or len(head) + 1 < len(best[end])):
                    best[end] = [*head, word[start:end]]
        return best[-1] or [word]


def _one_slip(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    rest_a, rest_b = a[i:], b[i:]
    return rest_a[1:] == rest_b or rest_a == rest_b[1:] or rest_a[1:] == rest_b[1:] or (rest_a[:2] == rest_b[1::-1] and rest_a[2:] == rest_b[2:])


class Vocabulary:
    """The corpus's frequent words: how many there are of each, and in what share they stand inside identifiers."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.speller = Speller({w: n for w, (n, _) in counts.items()})
        self.names = {w for w, (n, inside) in counts.items() if inside * 20 >= n and w not in PLAIN_WORDS}
        self.own = {w for w in self.names if counts[w][1] * 2 >= counts[w][0]}

    def __getstate__(self) -> dict:
        return {"speller": self.speller, "names": self.names, "own": self.own}


def _spelled_out(words: list[list[str]], known: Vocabulary) -> set[int]:
    """Where a thing's name is written as plain words: the longest run of name words that ends with one that hardly stands
    elsewhere, and the nearest such word before it, else after it. Empty if there is no run of two."""
    best: tuple[int, int] = (0, 0)
    start = 0
    for at in range(len(words) + 1):
        if at < len(words) and len(words[at]) == 1 and words[at][0] in known.names:
            if words[at][0] in known.own and at + 1 - start > best[1] - best[0] and at > start:
                best = (start, at + 1)
        else:
            start = at + 1
    begin, end = best
    if end == begin:
        return set()
    begin = max(begin, end - 4)
    near = [i for i in range(max(0, begin - 6), min(len(words), end + 4)) if not begin <= i < end and len(words[i]) == 1 and words[i][0] in known.own]
    verb = min(near, key=lambda i: (i > begin, abs(i - begin)), default=None)
    return set(range(begin, end)) | ({verb} if verb is not None else set())


def reduced(tokenised: str, known: Vocabulary) -> tuple[list[str], list[str]]:
    """(parts of the named thing, sorted; content words about it, sorted and distinct)."""
    words: list[list[str]] = []
    for token in tokenised.split(" "):
        parts = token.split("_")
        parts = [known.speller.mend(p) for p in (parts if len(parts) > 1 else known.speller.cut(parts[0])) if p]
        if parts and not (len(parts) == 1 and parts[0] in FILLERS):
            words.append(parts)
    names = [i for i, w in enumerate(words) if len(w) >= 3]
    at = {max(names, key=lambda i: len(words[i]))} if names else _spelled_out(words, known)
    if not at:
        at = {next((i for i, w in enumerate(words) if len(w) == 2), -1)}
    name = sorted({p for i in at if i >= 0 for p in words[i]})
    body = {p for i, w in enumerate(words) if i not in at for p in w} - PLAIN_WORDS
    return name, sorted(body)


_signs: dict[str, np.ndarray] = {}


def _sign(feature: str) -> np.ndarray:
    """The feature's bits as signs, times a weight of its own around 1: equal weights would often cancel out."""
    if feature not in _signs:
        if len(_signs) > 200_000:
            _signs.clear()
        digest = xxhash.xxh128_digest(feature)
        _signs[feature] = (np.unpackbits(np.frombuffer(digest, np.uint8)) * 2.0 - 1) * (0.6 + digest[0] / 320)
    return _signs[feature]


def simhash(name: list[str], body: list[str]) -> tuple[int, int]:
    """128 bits as two numbers; each bit is the sign of the weighted sum of the features' own bits. The parts of the name and
    their pairs weigh most. No features give 0."""
    total = np.zeros(128)
    for i, a in enumerate(name):
        total += NAME_WEIGHT * _sign(a)
        for b in name[i + 1 :]:
            total += NAME_WEIGHT * _sign(f"{a} {b}")
    for w in body:
        total += _sign(w)
    high, low = np.packbits(total > 0).view(">i8")
    return int(high), int(low)


def questions(records: DataFrame) -> DataFrame:
    """``record_id, side, split, repository_id, tokenised`` of the records that have a split and a question."""
    once = first_delivery(records.select("record_id", "split", "repository_id", "query_text", "ingested_at"), "record_id", ["ingested_at"])
    side = F.when(F.col("split").isin(*TRAIN), "train").when(F.col("split").isin(*EVALUATION), "evaluation")
    known = once.withColumn("side", side).where("side is not null and query_text is not null")
    return known.select("record_id", "side", "split", "repository_id", _tokenised("query_text").alias("tokenised")).where(F.length("tokenised") > 0)


def frequent_words(texts: DataFrame, share: float = 0.002) -> Vocabulary:
    """Words that at least ``share`` of the distinct texts hold, counted over all of them. They number at most the mean
    words of a text divided by ``share``, whatever the size of the corpus, so they may go to the driver."""
    total = texts.count()
    tokens = texts.select(F.explode(F.split("tokenised", " ")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    parts = F.split("t", "_")
    words = tokens.select(F.explode(F.array_distinct(parts)).alias("w"), "n", (F.size(parts) >= 3).alias("inside")).where("w <> ''")
    counts = words.groupBy("w").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside")).where(F.col("n") >= max(3, share * total))
    return Vocabulary({r["w"]: (r["n"], r["inside"]) for r in counts.collect()})


def classes(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """Each distinct tokenised text with its class: ``tokenised, class_id, name, body, high, low``."""
    schema = "tokenised string, name array<string>, body array<string>, high long, low long"

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.tokenised:
                name, body = reduced(text, known)
                rows.append((text, name, body, *simhash(name, body)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    made = texts.mapInPandas(reduce, schema)
    return made.withColumn("class_id", F.md5(F.concat_ws("|", F.concat_ws(" ", "name"), F.concat_ws(" ", "body"))))


def _segment(side: str, i: int) -> Column:
    half, at = ("high", i) if i * BITS < 64 else ("low", i - 64 // BITS)
    return F.shiftrightunsigned(F.col(f"{side}{half}"), at * BITS).bitwiseAND(F.lit((1 << BITS) - 1))


def _distance() -> Column:
    return F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high"))) + F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low")))


def same_question() -> Column:
    """Each text holds what the other names, they name something in common or nothing at all, and at least ``LEAST`` of the
    words of the shorter question stand in the other, two of them or all."""
    everything = {s: F.concat(f"{s}.name", f"{s}.body") for s in "ab"}
    named = (F.size(F.array_except("a.name", everything["b"])) == 0) & (F.size(F.array_except("b.name", everything["a"])) == 0)
    common, fewest = F.size(F.array_intersect("a.name", "b.name")), F.least(F.size("a.name"), F.size("b.name"))
    named = named & ((common >= F.least(fewest, F.lit(2))) & ((fewest > 0) | ((F.size("a.name") == 0) & (F.size("b.name") == 0))))
    shared, fewer = F.size(F.array_intersect("a.body", "b.body")), F.least(F.size("a.body"), F.size("b.body"))
    return named & (shared >= F.lit(LEAST) * fewer) & (shared >= F.least(fewer, F.lit(2)))


def _worded(rows: DataFrame, order: DataFrame, every: bool) -> DataFrame:
    """A row per word of a hot block's class: all its words, or as many of the rarest as a match can't do without."""
    words = rows.select("at", "segment", "class_id", "high", "low", F.explode("body").alias("word"))
    if every:
        return words
    rare = Window.partitionBy("at", "segment", "class_id").orderBy("n", "word")
    ranked = words.join(order, "word").withColumn("_r", F.row_number().over(rare)).withColumn("_n", F.count("*").over(Window.partitionBy("at", "segment", "class_id")))
    return ranked.where(F.col("_r") <= F.col("_n") - F.ceil(F.lit(LEAST) * F.col("_n")) + 1).drop("n", "_r", "_n")


def _probes(rows: DataFrame) -> DataFrame:
    """``rows`` with a row per value of their block that lies within the block's allowance: the block itself, and in the first
    ``LENIENT`` blocks each value that is one bit away."""
    masks = F.when(F.col("at") < LENIENT, F.array(F.lit(0), *[F.lit(1 << i) for i in range(BITS)])).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_mask", F.explode(masks)).withColumn("segment", F.col("segment").bitwiseXOR(F.col("_mask"))).drop("_mask")


def _first() -> Column:
    """Whether no block before ``a.at`` lies within its allowance."""
    first = F.lit(True)
    for i in range(SEGMENTS - 1):
        apart = F.bit_count(_segment("a.", i).bitwiseXOR(_segment("b.", i)))
        first = first & ((F.col("a.at") <= i) | (apart > (1 if i < LENIENT else 0)))
    return first


def candidates(reps: DataFrame) -> DataFrame:
    """``a, b``: ids of different classes, the one with training members, the other with evaluation members, that lie within
    ``RADIUS`` bits; all of them.

    If the blocks allow for 1 bit in ``LENIENT`` of them and for none in the others, codes that exceed every allowance are more
    than ``RADIUS`` bits apart, so each pair has a block within its allowance. It comes from the first such block, so it is
    compared once. Equal codes are compared once, whatever their classes. Where one block would take more than ``HOT``
    comparisons, its pairs must also share a word as any match does: of the words of the shorter question, all but
    ``1 - LEAST`` stand in the other, so one of its rarest does. Classes without words meet among themselves: a name alone
    makes one class.
    """
    parts = F.posexplode(F.array(*[_segment("", i) for i in range(SEGMENTS)])).alias("at", "segment")
    codes = cut(reps.groupBy("high", "low").agg(F.max("has_train").alias("has_train"), F.max("has_evaluation").alias("has_evaluation")))
    rows = codes.select("high", "low", "has_train", "has_evaluation", parts)
    sizes = cut(rows.groupBy("at", "segment").agg(F.count_if("has_train").alias("t"), F.count_if("has_evaluation").alias("e")))
    # values that few codes have add little to a block, so only the others are spread over their neighbours
    near = _probes(sizes.where(F.col("e") * (BITS + 1) >= HOT**0.5).select("at", "segment", "e")).groupBy("at", "segment").agg(F.sum("e").alias("e"))
    hot = cut(sizes.select("at", "segment", "t").join(near, ["at", "segment"]).where(F.col("t") * F.col("e") > HOT).select("at", "segment"))
    within = (_distance() <= RADIUS) & _first()
    train, evaluation = reps.where("has_train"), reps.where("has_evaluation")

    def of_classes(pairs: DataFrame) -> DataFrame:
        """The classes of pairs of codes."""
        x, y = train.select(F.col("class_id").alias("a"), "high", "low"), evaluation.select(F.col("class_id").alias("b"), "high", "low")
        both = pairs.join(x, [pairs["ah"] == x["high"], pairs["al"] == x["low"]]).select("a", "bh", "bl")
        return both.join(y, [both["bh"] == y["high"], both["bl"] == y["low"]]).where("a <> b").select("a", "b")

    narrow = ["at", "segment", "high", "low"]
    a, b = rows.where("has_train").select(narrow), _probes(rows.where("has_evaluation").select(narrow))
    some = not hot.isEmpty()
    if some:
        a, b = (x.join(hot, ["at", "segment"], "left_anti") for x in (a, b))
    close = a.alias("a").join(b.alias("b"), ["at", "segment"]).where(within)
    few = of_classes(close.select(F.col("a.high").alias("ah"), F.col("a.low").alias("al"), F.col("b.high").alias("bh"), F.col("b.low").alias("bl")))
    if not some:
        return few
    wide = ["class_id", "high", "low", "body", parts]
    hot_a, hot_b = (x.join(hot, ["at", "segment"], "left_semi") for x in (train.select(*wide), _probes(evaluation.select(*wide))))
    different = (F.col("a.class_id") != F.col("b.class_id")) & within
    pair = [F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b")]
    found = few
    order = reps.select(F.explode("body").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    for every_a, every_b in ((True, False), (False, True)):
        x, y = _worded(hot_a, order, every_a).alias("a"), _worded(hot_b, order, every_b).alias("b")
        found = found.unionByName(x.join(y, ["at", "segment", "word"]).where(different).select(*pair))
    for x, y in ((hot_a.where("size(body) = 0"), hot_b), (hot_a.where("size(body) > 0"), hot_b.where("size(body) = 0"))):  # a name alone: one class a name
        found = found.unionByName(x.alias("a").join(y.alias("b"), ["at", "segment"]).where(different).select(*pair))
    return found.distinct()


def matching_classes(reps: DataFrame) -> DataFrame:
    """``train_class, evaluation_class``: candidates whose texts ask the same."""
    near = candidates(reps)
    words = reps.select("class_id", "name", "body")
    both = near.join(words.alias("a"), F.col("a.class_id") == near["a"]).join(words.alias("b"), F.col("b.class_id") == near["b"])
    return both.where(same_question()).select(F.col("a.class_id").alias("train_class"), F.col("b.class_id").alias("evaluation_class"))


def members_and_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their class, links between classes of train and evaluation, a class with itself included)."""
    known = cut(questions(records))
    texts = cut(known.groupBy("tokenised").agg(F.max(F.col("side") == "train").alias("has_train"), F.max(F.col("side") == "evaluation").alias("has_evaluation")))
    made = cut(classes(texts.select("tokenised"), frequent_words(texts)))
    reps = made.join(texts, "tokenised").groupBy("class_id").agg(
        F.first("name").alias("name"), F.first("body").alias("body"), F.first("high").alias("high"), F.first("low").alias("low"),
        F.max("has_train").alias("has_train"), F.max("has_evaluation").alias("has_evaluation"),
    ).where("size(name) + size(body) > 0")
    reps = cut(reps)
    itself = reps.where("has_train and has_evaluation").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("evaluation_class"))
    members = known.join(made.select("tokenised", "class_id"), "tokenised").select("record_id", "side", "split", "repository_id", "class_id")
    return members, matching_classes(reps).unionByName(itself)


def pairs(records: DataFrame) -> DataFrame:
    """``record_id_a, record_id_b``: every overlapping pair across the splits, the smaller id first.

    Records without id, split or words are no cases; re-delivered records count once; exact copies are paired through
    their class. The result holds each pair, so a question copied n times in train and m times in evaluation gives n * m.
    """
    members, links = members_and_links(records)
    members = cut(members)
    t = members.where("side = 'train'").select(F.col("record_id").alias("t"), F.col("class_id").alias("train_class"))
    e = members.where("side = 'evaluation'").select(F.col("record_id").alias("e"), F.col("class_id").alias("evaluation_class"))
    both = links.join(e, "evaluation_class").join(t, "train_class")
    return both.select(F.least("t", "e").alias("record_id_a"), F.greatest("t", "e").alias("record_id_b"))


def report(records: DataFrame) -> DataFrame:
    """Per split and repository as written: evaluation records, and those that overlap with training. No pairs are made."""
    members, links = members_and_links(records)
    hit = links.select(F.col("evaluation_class").alias("class_id")).distinct().withColumn("hit", F.lit(1))
    rows = members.where("side = 'evaluation'").join(hit, "class_id", "left")
    return rows.groupBy("split", "repository_id").agg(F.count("*").alias("records"), F.sum(F.coalesce("hit", F.lit(0))).alias("overlapping"))
