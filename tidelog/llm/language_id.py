"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, chunks, dropped, is_held_out, mix64, shared_dir, small_batches, written

ORDER = 4
#: n-grams of all languages that tasks are sent. Beyond it the models stay tables: tasks are sent the most frequent
#: n-grams, and the others are answered by joins, with the same probabilities.
MAX_GRAMS = 4_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
FLUSH_GRAMS = 2_000_000
#: A document is rejected when its cross-entropy lies over its language's mean by more than GAP_FACTOR times the mean
#: distance to the next language and, as short texts stray, REJECT_FACTOR times what all but a thousandth of the training
#: documents stray beyond that.
REJECT_FACTOR = 2.0
GAP_FACTOR = 2.0
#: Bits a character that this distance is at most: models of few documents lie far apart.
GAP_MOST = 3.0
_SHIFT = np.uint64(16)


def _fold(code: int) -> int:
    """Lower-case letters keep their code (16 bits, others fold into the private use area); 0 for all else."""
    c = chr(code)
    if not c.isalpha():
        return 0
    low = ord(c.lower()[0])
    return low if low < 0x10000 else 0xE000 + low % 0x1900


_TABLE: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """uint16 codes of the text's letters; 0 for each other character."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([0 if 0xD800 <= c < 0xE000 else _fold(c) for c in range(0x10000)], np.uint16)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(codes, 0xFFFF)]
    if len(astral := np.flatnonzero(codes > 0xFFFF)):
        seen, back = np.unique(codes[astral], return_inverse=True)
        out[astral] = np.array([_fold(int(c)) for c in seen], np.uint16)[back]
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of the texts, one ending at each character, the document each is of, and letters of each.

    Runs of other characters count as one; a text begins with ORDER - 1 of them.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = letters("".join(texts))
    doc = np.repeat(np.arange(len(texts)), lengths)
    n_letters = np.bincount(doc[codes != 0], minlength=len(texts))
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    before = np.concatenate([np.zeros(1, np.uint16), codes[:-1]])
    keep = (codes != 0) | ((before != 0) & ~first)
    codes, doc = codes[keep], doc[keep]
    sizes = np.bincount(doc, minlength=len(texts))
    at = np.arange(len(codes)) + (doc + 1) * (ORDER - 1)
    line = np.zeros(len(codes) + len(texts) * (ORDER - 1), np.uint64)
    line[at] = codes
    key = line[at]
    for back in range(1, ORDER):
        key |= line[at - back] << np.uint64(16 * back)
    assert len(key) == sizes.sum()
    return key, doc, n_letters


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language: summed in each task, then over tasks."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            _, offsets = byte_values(batch.column(1))
            for first, last in chunks(offsets):
                langs = batch.column(0).slice(first, last - first).to_pylist()
                key, doc, _ = grams(batch.column(1).slice(first, last - first).to_pylist())
                for lang in set(langs):
                    mine = np.array([x == lang for x in langs])[doc]
                    keys, n = np.unique(key[mine], return_counts=True)
                    held[lang] = _merged([held[lang], (keys, n)] if lang in held else [(keys, n)])
            if sum(len(k) for k, _ in held.values()) > FLUSH_GRAMS:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hashed(keys: np.ndarray, order: int) -> np.ndarray:
    return mix64(keys + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64))


@dataclass
class Sorted:
    """Hashes in order, values beside them, and where each range of leading bits begins."""

    keys: np.ndarray
    values: np.ndarray
    begins: np.ndarray
    shift: int

    @classmethod
    def of(cls, hashes: np.ndarray, values: np.ndarray) -> Sorted:
        order = np.argsort(hashes)
        keys = np.append(hashes[order], np.uint64(2**64 - 1))
        bits = max(1, int(len(keys)).bit_length())
        begins = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        return cls(keys, values[order], begins, 64 - bits)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes, and whether they are there."""
        at = self.begins[hashes >> np.uint64(self.shift)]
        low = np.flatnonzero(self.keys[at] < hashes)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < hashes[low]]
        there = (self.keys[at] == hashes) & (at < len(self.values))
        return at, there


@dataclass
class Model:
    """Of one language, for each order: the discounted part of each n-gram and the weight of each context's next order."""

    own: list[Sorted]
    rest: list[Sorted]
    floor: float

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray) -> Model:
        own, rest, letters_seen = [], [], 0
        for order in range(ORDER, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            cut = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
            context, back = np.unique(keys >> _SHIFT, return_inverse=True)
            total = np.bincount(back, counts)
            own.append(Sorted.of(_hashed(keys, order), (np.maximum(counts - cut, 0) / total[back]).astype(np.float32)))
            rest.append(Sorted.of(_hashed(context, order), (cut * np.bincount(back) / total).astype(np.float32)))
            letters_seen = len(keys)
            keys, counts = np.unique(keys & np.uint64((1 << (16 * (order - 1))) - 1), return_counts=True)
        return cls(own, rest, 1.0 / (letters_seen + 1))

    def prob(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        """Interpolated probability of each n-gram's last character after the ones before."""
        order = ORDER - level
        if order == 0:
            return np.full(len(keys), self.floor)
        at, there = self.own[level].find(_hashed(keys, order))
        p = np.where(there, self.own[level].values[np.minimum(at, len(self.own[level].values) - 1)], 0)
        at, there = self.rest[level].find(_hashed(keys >> _SHIFT, order))
        weight = np.where(there, self.rest[level].values[np.minimum(at, len(self.rest[level].values) - 1)], 1)
        return p + weight * self.prob(keys & np.uint64((1 << (16 * (order - 1))) - 1), level + 1)


def _by_lang(values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for x in values.items() for v in x]), F.col("lang"))


@dataclass
class Tables:
    """What :class:`Model` holds, as tables: ``own`` by lang and n-gram, ``rest`` by lang and context, for each order."""

    own: list[DataFrame]
    rest: list[DataFrame]
    floor: dict[str, float]

    @classmethod
    def fit(cls, counted: DataFrame) -> Tables:
        where, own, rest, now = shared_dir(counted.sparkSession), [], [], counted
        for order in range(ORDER, 0, -1):
            rows = now.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count("*").alias("all")).collect()
            cut = _by_lang({r.lang: min(0.95, max(0.1, r.n1 / (r.n1 + 2 * r.n2))) if r.n1 else 0.1 for r in rows})
            floor = {r.lang: 1.0 / (r["all"] + 1) for r in rows}
            with_context = now.withColumn("context", F.shiftrightunsigned("gram", 16))
            contexts = written(with_context.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), f"{where}/contexts{order}")
            part = F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total")
            own.append(written(with_context.join(contexts, ["lang", "context"]).select("lang", "gram", part.alias("p")), f"{where}/own{order}"))
            rest.append(contexts.select("lang", "context", (cut * F.col("kinds") / F.col("total")).alias("w")))
            if order > 1:
                shorter = F.col("gram").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1).cast("long"))
                now = written(now.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")), f"{where}/counts{order - 1}")
        return cls(own, rest, floor)

    def bits(self, needed: DataFrame, langs: list[str]) -> DataFrame:
        """``gram`` of the distinct n-grams in ``needed``, and ``bits`` in each of ``langs``: one join an order and part."""
        now = needed.select("gram", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang")).withColumn("q", _by_lang(self.floor))
        for order in range(1, ORDER + 1):
            suffix = F.col("gram") if order == ORDER else F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1).cast("long"))
            own = self.own[ORDER - order].withColumnRenamed("gram", "suffix")
            now = now.withColumn("suffix", suffix).withColumn("context", F.shiftrightunsigned("suffix", 16))
            now = now.join(own, ["lang", "suffix"], "left").join(self.rest[ORDER - order], ["lang", "context"], "left")
            now = now.select("gram", "lang", (F.coalesce("p", F.lit(0.0)) + F.coalesce("w", F.lit(1.0)) * F.col("q")).alias("q"))
        each = F.map_from_entries(F.collect_list(F.struct("lang", -F.log2("q"))))
        return now.groupBy("gram").agg(each.alias("m")).select("gram", F.array(*[F.element_at("m", F.lit(x)) for x in langs]).alias("bits"))


@dataclass
class Identifier:
    langs: list[str]
    models: list[Model]
    known: Sorted  # n-grams of any language, every one if there are models; values: bits in each language
    tables: Tables | None = None
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None
    gap: np.ndarray | None = None

    def known_bits(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each n-gram in each language, and the places of those that are not known, of zeros for now."""
        if len(self.known.values) == 0:
            return np.zeros((len(key), len(self.langs)), np.float32), np.arange(len(key))
        at, there = self.known.find(_hashed(key, ORDER))
        bits = self.known.values[np.where(there, at, 0)]
        lost = np.flatnonzero(~there)
        bits[lost] = 0
        return bits, lost

    def sums(self, bits: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        return np.stack([np.bincount(doc, bits[:, i], docs) for i in range(len(self.langs))], 1)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character in each language (documents x languages), characters and letters of each document."""
        key, doc, n_letters = grams(texts)
        bits, lost = self.known_bits(key)
        if len(lost):
            seen, back = np.unique(key[lost], return_inverse=True)
            bits[lost] = np.stack([-np.log2(m.prob(seen)) for m in self.models], 1)[back]
        n = np.bincount(doc, minlength=len(texts))
        return self.sums(bits, doc, len(texts)) / np.maximum(n, 1)[:, None], n, n_letters

    def judged(self, entropy: np.ndarray, n: np.ndarray, n_letters: np.ndarray) -> list[pa.Array]:
        """lang_pred, score, bits, next_bits, n, rejected."""
        best, blank = entropy.argmin(1), n_letters == 0
        names = ["und" if b else self.langs[i] for i, b in zip(best, blank, strict=True)]
        low = entropy[np.arange(len(n)), best]
        odds = np.exp2(-(entropy - low[:, None]) * np.sqrt(n)[:, None])
        rejected = blank.copy()
        if self.limit is not None:
            rejected |= low - self.mean[best] > self.gap[best] + self.limit[best] / np.sqrt(np.maximum(n, 1))
        other = np.where(blank, np.nan, np.partition(entropy, 1, 1)[:, 1]) if len(self.langs) > 1 else [None] * len(n)
        bits = np.where(blank, np.nan, low)
        return [
            pa.array(names, pa.string()), pa.array(np.where(blank, 0, 1 / odds.sum(1)), pa.float64()), pa.array(bits, pa.float64(), from_pandas=True),
            pa.array(other, pa.float64(), from_pandas=True), pa.array(n, pa.int64()), pa.array(rejected),
        ]


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def fit(docs: DataFrame, max_grams: int = MAX_GRAMS) -> Identifier | None:
    """Models of the counts over every row of ``docs`` with text and lang; ``max_grams`` n-grams at most come to the driver.

    No count is left out: of more n-grams than that, the models are
    :class:`Tables`, and only the most frequent n-grams come, with the bits
    that the tables give them.
    """
    where = shared_dir(docs.sparkSession)
    counted = written(count_grams(docs), where)
    if counted.count() > max_grams:
        tables = Tables.fit(counted)
        langs, least = sorted(tables.floor), 2
        while (often := counted.where(F.col("n") >= least).select("gram").distinct()).count() * len(langs) > max_grams:
            least *= 2
        head = tables.bits(often, langs).toPandas()
        bits = np.array(head["bits"].tolist(), np.float32).reshape(-1, len(langs))
        return Identifier(langs, [], Sorted.of(_hashed(_unsigned(head["gram"]), ORDER), bits), tables)
    pairs = counted.toPandas()
    dropped(docs.sparkSession, where)
    models: dict[str, Model] = {}
    union = np.unique(_unsigned(pairs["gram"]))
    for lang, own in sorted(pairs.groupby("lang"), key=lambda x: x[0]):
        models[lang] = Model.fit(_unsigned(own["gram"]), own["n"].to_numpy(np.float64))
    if not models:
        return None
    bits = np.stack([-np.log2(m.prob(union)) for m in models.values()], 1).astype(np.float32)
    return Identifier(list(models), list(models.values()), Sorted.of(_hashed(union, ORDER), bits))


def calibrate(found: Identifier, docs: DataFrame, factor: float = REJECT_FACTOR) -> Identifier:
    """Learns when to reject, from the cross-entropies of all training documents in their own language.

    The limit is a distance that all texts may have, GAP_FACTOR times the mean
    distance to the next best language (two bits a character, if there is no
    other), so that text of two languages is no reason to reject; and one that
    falls as 1 / sqrt(n) with the characters: of training documents, and four
    times the mean at least.
    """
    where = shared_dir(docs.sparkSession)
    scored = _scored(found, docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")).where(F.col("bits").isNotNull() & (F.col("lang_pred") == F.col("lang")))
    scored = written(scored.select("lang", "bits", "next_bits", "n"), f"{where}/scored")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    rows = {r.lang: r for r in scored.groupBy("lang").agg(mean("bits").alias("mean"), mean("next_bits").alias("next")).collect()}
    found.mean = np.array([rows[x].mean if x in rows else 8.0 for x in found.langs])
    found.gap = np.array([min(GAP_MOST, GAP_FACTOR * (rows[x].next - rows[x].mean)) if x in rows and rows[x].next is not None else 2.0 for x in found.langs])
    means, gaps = (_by_lang(dict(zip(found.langs, map(float, x), strict=True))) for x in (found.mean, found.gap))
    strays = scored.groupBy("lang").agg(F.percentile_approx((F.col("bits") - means - gaps) * F.sqrt("n"), 0.999, 10000).alias("z"))
    top = {r.lang: r.z for r in strays.collect()}
    found.limit = np.array([max(factor * (top.get(x) or 0.0), 4 * m) for x, m in zip(found.langs, found.mean, strict=True)])
    dropped(docs.sparkSession, where)
    return found


_JUDGED = "doc_id long, lang string, doc_key long, lang_pred string, score double, bits double, next_bits double, n long, rejected boolean"
_NAMES = [x.split()[0] for x in _JUDGED.split(", ")]


def _scored(found: Identifier | None, docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    if found is not None and found.tables is not None:
        return _scored_by_tables(found, rows)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, offsets = byte_values(batch.column(3))
            for first, last in chunks(offsets):
                size = last - first
                part = batch.slice(first, size)
                if model is None:
                    none = pa.nulls(size, pa.float64())
                    judged = [pa.array(["und"] * size, pa.string()), pa.array(np.zeros(size)), none, none, pa.array(np.zeros(size, np.int64)), pa.array(np.ones(size, bool))]
                else:
                    judged = model.judged(*model.cross_entropy([t or "" for t in part.column(3).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *judged], names=_NAMES)

    return rows.mapInArrow(run, _JUDGED)


def _scored_by_tables(found: Identifier, rows: DataFrame) -> DataFrame:
    """As models that tasks hold would score: what tasks know is summed there, the other n-grams are joined with the tables."""
    spark = rows.sparkSession
    shared, tables, langs = spark.sparkContext.broadcast(replace(found, tables=None)), found.tables, found.langs

    def sum_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, offsets = byte_values(batch.column(3))
            for first, last in chunks(offsets):
                part, size = batch.slice(first, last - first), last - first
                key, doc, n_letters = grams([t or "" for t in part.column(3).to_pylist()])
                bits, lost = model.known_bits(key)
                order = lost[np.lexsort((key[lost], doc[lost]))]
                begins = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(order) else order
                pairs = pa.StructArray.from_arrays([pa.array(key[order][begins].view(np.int64)), pa.array(np.diff(np.append(begins, len(order))).astype(np.int64))], ["gram", "k"])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[order][begins], minlength=size))]).astype(np.int32)
                sums = pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * len(langs), pa.array(model.sums(bits, doc, size).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], part.column(4), pa.array(np.bincount(doc, minlength=size)), pa.array(n_letters), sums, pa.ListArray.from_arrays(ends, pairs)],
                    names=["doc_id", "lang", "doc_key", "row", "n", "n_letters", "sums", "lost"],
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                sums = np.array(batch.column(5).to_pylist(), float)
                n, n_letters = (batch.column(i).to_numpy() for i in (3, 4))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *model.judged(sums / np.maximum(n, 1)[:, None], n, n_letters)], names=_NAMES)

    schema = "doc_id long, lang string, doc_key long, row long, n long, n_letters long, sums array<double>, lost array<struct<gram:long,k:long>>"
    known = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(sum_known, schema), f"{shared_dir(spark)}/known")
    lost = known.select("row", F.inline("lost"))
    bits = tables.bits(lost.select("gram").distinct(), langs)
    more = lost.join(bits, "gram").groupBy("row").agg(F.array(*[F.sum(F.col("k") * F.col("bits")[i]) for i in range(len(langs))]).alias("more"))
    whole = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    return known.drop("lost").join(more, "row", "left").select("doc_id", "lang", "doc_key", "n", "n_letters", whole.alias("sums")).mapInArrow(judge, _JUDGED)


def identify(docs: DataFrame, found: Identifier | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits, rejected for each row.

    The language is the one whose model needs the fewest bits a character.
    ``score`` weighs it against the others (0 to 1); ``rejected`` tells that
    even its model needs more bits than it does on anything it was made from.

    Defined cases: null, empty and letterless texts are ``und`` with score 0
    and rejected, as is every text if nothing could be learned; equal
    languages go to the first by name; repeated rows are answered each; a null
    id is not held out; columns but doc_id and text are not read.
    """
    rows = _scored(found, docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    return rows.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "bits", "rejected", "doc_key")


def learn(docs: DataFrame, max_grams: int = MAX_GRAMS) -> Identifier | None:
    """Models and rejection limits from the rows that are not held out."""
    small_batches(docs.sparkSession)
    training = docs.where(~is_held_out())
    found = fit(training, max_grams)
    return found and calibrate(found, training)
