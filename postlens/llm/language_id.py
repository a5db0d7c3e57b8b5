"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to `ORDER` bytes long is counted in Spark and frozen.
A byte costs -log2 of its share in the longest known context; where it was never seen there, the
escape's cost (method C: one for each different byte that followed) and the cost in the context one
byte shorter, down to one of 256. The language with the shortest code for the whole text wins.

All escapes are worked out when the model is built: a table per order holds, for each n-gram that any
language knows, what it costs in every language. Scoring is then a hash lookup per byte, and one more
per order for the few n-grams that no language has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.minhash import sliced

ORDER = 4
#: Most texts of each language to learn from, chosen by a hash of the id; with fewer, all are taken.
TRAIN_ROWS = 2_000
#: Languages that share tables. An n-gram takes a cost for each of them, so that a model grows with the
#: counts learnt from, not with n-grams times languages.
GROUP = 16
BLOCK = 1 << 17
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; numerals such as a half are not."""
    return any(map(str.isalpha, text))



def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place from the n-th on, as numbers."""
    size = len(data) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out <<= np.uint64(8)
        out |= data[i:i + size]
    return out


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes, each after `ORDER` line ends that start its contexts; begins and ends."""
    parts = [b"\n" * ORDER + t.encode() for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - np.array([len(p) - ORDER for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), begins, ends


def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each batch and language."""
    for table in sliced(it):
        langs, texts = table["lang"].to_pylist(), table["text"].to_pylist()
        for lang in sorted(set(langs)):
            data, begins, ends = joined([t for t, x in zip(texts, langs, strict=True) if x == lang])
            inside = np.zeros(len(data), bool)
            for b, e in zip(begins, ends, strict=True):
                inside[b:e] = True
            for n in range(1, ORDER + 2):
                keys, k = np.unique(grams(data, n)[inside[n - 1:]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array([n] * len(keys), pa.int32()),
                     pa.array(keys.view(np.int64)), pa.array(k, pa.int64())],
                    names=["lang", "n", "gram", "count"])


class Lookup:
    """Numbers of 64-bit keys, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.number[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[at[won]], self.number[at[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = self.slot(keys)
        out = np.where(self.key[at] == keys, self.number[at], -2)
        left = np.flatnonzero(out == -2)
        at = at[left]
        while len(left):
            out[left[self.number[at] < 0]] = -1
            right = (self.number[at] >= 0) & (self.key[at] == keys[left])
            out[left[right]] = self.number[at[right]]
            more = (self.number[at] >= 0) & ~right
            left, at = left[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


class Trees:
    """Costs in bits of a few languages: for n = 1 .. ORDER + 1 a lookup of n-grams with their costs by
    language; for each context length a lookup of contexts with the costs of their escapes."""

    def __init__(self, langs: int, rows: dict[str, np.ndarray]):
        self.langs, lang = langs, rows["lang"]
        self.gram_lookup, self.gram_cost = [], []
        self.context_lookup, self.escape = [], []
        for n in range(1, ORDER + 2):
            here = rows["n"] == n
            keys, at = np.unique(rows["gram"][here], return_inverse=True)
            count = np.zeros((len(keys), langs))
            np.add.at(count, (at, lang[here]), rows["count"][here])
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = (np.zeros((len(contexts), langs)) for _ in range(2))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                seen = np.log2((total + kinds)[of] / count)
            shorter = keys & np.uint64((1 << 8 * (n - 1)) - 1)
            cost = np.where(count > 0, seen, escape[of] + self.costs(shorter, n - 1))
            self.gram_lookup.append(Lookup(keys))
            self.gram_cost.append(cost.astype(np.float32))
            self.context_lookup.append(Lookup(contexts))
            self.escape.append(escape.astype(np.float32))

    def costs(self, keys: np.ndarray, n: int) -> np.ndarray:
        """What n-grams cost in each language."""
        if n == 0:
            return np.full((len(keys), self.langs), 8.0, np.float32)
        at = self.gram_lookup[n - 1].find(keys)
        if not len(self.gram_cost[n - 1]):
            return self.costs(keys & np.uint64((1 << 8 * (n - 1)) - 1), n - 1)
        out = self.gram_cost[n - 1][at]
        missed = np.flatnonzero(at < 0)
        if len(missed):
            rest = keys[missed]
            out[missed] = self.costs(rest & np.uint64((1 << 8 * (n - 1)) - 1), n - 1)
            context = self.context_lookup[n - 1].find(rest >> np.uint64(8))
            known = context >= 0
            out[missed[known]] += self.escape[n - 1][context[known]]
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        data, begins, ends = joined(texts)
        out = np.zeros((len(texts), self.langs))
        for b in range(ORDER, len(data), BLOCK):
            e = min(len(data), b + BLOCK)
            cost = self.costs(grams(data[b - ORDER:e], ORDER + 1), ORDER + 1).astype(np.float64)
            i, j = np.searchsorted(ends, b, side="right"), np.searchsorted(begins, e)
            # Sums over the part of each text in this block; the line ends between count for none.
            total = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0)])
            low, high = np.maximum(begins[i:j], b) - b, np.minimum(ends[i:j], e) - b
            out[i:j] += total[np.maximum(low, high)] - total[low]
        return out


class Model:
    """`langs` and their trees, `GROUP` languages at a time; `rows` has languages by their number."""

    def __init__(self, langs: list[str], rows: dict[str, np.ndarray]):
        self.langs, self.groups = langs, []
        order = np.argsort(rows["lang"], kind="stable")
        rows = {k: v[order] for k, v in rows.items()}
        for first in range(0, len(langs), GROUP):
            last = min(first + GROUP, len(langs))
            b, e = np.searchsorted(rows["lang"], [first, last])
            mine = {k: v[b:e] for k, v in rows.items()}
            self.groups.append(Trees(last - first, mine | {"lang": mine["lang"] - first}))

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language, in bits."""
        return np.concatenate([g.lengths(texts) for g in self.groups], axis=1)


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
          most: int = TRAIN_ROWS) -> Model:
    """Learn from texts with a language that are not held out, about `most` of each language."""
    usable = docs.where(docs[text].isNotNull() & docs[lang].isNotNull() & ~held_out(docs[id])) \
        .select(docs[lang].alias("lang"), docs[text].alias("text"),
                F.pmod(F.xxhash64(docs[id]), F.lit(1 << 30)).alias("dice"))
    sizes = usable.groupBy("lang").count() \
        .select("lang", (F.lit(float(most)) / F.col("count") * (1 << 30)).alias("limit"))
    # One row per language: sent to all, so that no text is shuffled by language.
    chosen = usable.join(F.broadcast(sizes), "lang").where("dice < limit").select("lang", "text")
    rows = chosen.mapInArrow(counted, "lang string, n int, gram long, count long") \
        .groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")).toArrow()
    named = rows["lang"].combine_chunks().dictionary_encode()
    names = named.dictionary.to_pylist()
    langs = sorted(names)
    place = {x: i for i, x in enumerate(langs)}
    number = np.array([place[x] for x in names], np.int64)
    columns = {"lang": number[named.indices.to_numpy()], "n": rows["n"].to_numpy(),
               "gram": rows["gram"].to_numpy().astype(np.int64).view(np.uint64),
               "count": rows["count"].to_numpy()}
    return Model(langs, columns)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `score` (how likely the language is among those known, 0 to 1) and
    `bits_per_byte`; columns so named are replaced.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing was
    learnt. Of languages with equal code lengths the first by name wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [docs[c] for c in docs.columns
            if c != text and c not in ("lang_pred", "score", "bits_per_byte")]
    packed = docs.select(docs[text].alias("text"), F.struct(F.lit(0).alias("__"), *rest).alias("rest"))

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in sliced(it):
            texts = [t or "" for t in table["text"].to_pylist()]
            if model.langs:
                bits = model.lengths(texts)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
            known = np.array([bool(model.langs) and has_letter(t) for t in texts])
            name = [model.langs[best[i]] if k else UNKNOWN for i, k in enumerate(known)]
            size = np.array([max(1, len(t.encode())) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [table["text"].combine_chunks(), table["rest"].combine_chunks(),
                 pa.array(name, pa.string()),
                 pa.array(np.where(known, score, 0.0) if model.langs else np.zeros(len(texts))),
                 pa.array(bits.min(axis=1) / size if model.langs else np.zeros(len(texts)))],
                names=["text", "rest", "lang_pred", "score", "bits_per_byte"])

    kind = packed.schema["rest"].dataType.simpleString()
    out = packed.mapInArrow(predict, f"text string, rest {kind}, lang_pred string, score double, "
                                     "bits_per_byte double")
    added = ["lang_pred", "score", "bits_per_byte"]
    own = [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c)
           for c in docs.columns if c not in added]
    return out.select(*own, *added)
