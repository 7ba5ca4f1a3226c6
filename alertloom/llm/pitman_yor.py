"""Scores by a hierarchical Pitman-Yor model with sampled seating.

A word's context is the whole word before it (at a text's begin: the end token). Each context is a restaurant. Its parent is that of its class
(the context's last two bytes, hashed into 63 classes; the text's begin is one of its own), groups of eight classes share a parent, and these
share the root, the empty context, whose base gives every training word, and one unseen word, the same probability. Customers of a context
are training tokens; who sits at a new table sends a customer to the parent.

Gibbs sampling re-seats all customers of a word in a restaurant at once, given the tables of everything else: one by
one up to EXACT customers, beyond that in steps that double, with a binomial number of new tables each. All that belongs to a word lies
in one bucket (by its hash), so buckets are sampled side by side. Between sweeps they exchange the number of
tables and customers of the 64 + 8 + 1 upper restaurants, and of each context: these are added up in buckets of contexts, which
answer every bucket of words for the contexts that it holds. A sweep's draws come from a generator seeded by bucket and sweep, so a
bucket repeats earlier sweeps exactly instead of storing them. Predictive probabilities are averaged over the
sweeps after BURN_IN, then logs are summed.

Texts move once, into a table bucketed by block. A block asks each bucket for its distinct pairs of word and context, with
training counts, and gets their log probabilities back: a frequent pair costs a block one number, however often
it occurs.

Null or empty text: the end token alone. A null doc_id counts as the text "". Rows with equal doc_id are scored each.
Other columns are ignored. No rows: no rows; without training rows every token is unseen.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.store import bucketed as _bucketed

CLASSES, GROUPS = 64, 8
#: By level: root, groups, classes, contexts.
DISCOUNT = (0.8, 0.8, 0.8, 0.8)
STRENGTH = (1.0, 1.0, 1.0, 1.0)
SWEEPS, BURN_IN = 3, 1
EXACT = 16
BLOCK_TEXT = 16 << 20
#: A word's class stands in the last bits of its hash. The end of text has class 0.
_CLASS = CLASSES - 1
_END = xxhash.xxh3_64_intdigest(b"\0end of text") & ~_CLASS


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, every token's place among these, and where each text's tokens begin (one more than texts)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    real = pc.binary_length(flat).to_numpy() > 0
    coded = flat.dictionary_encode()
    del lists, flat
    words = [w.encode() for w in pc.ascii_lower(coded.dictionary).to_pylist()]
    kinds = (zlib.crc32(w[-2:]) % (CLASSES - 1) + 1 for w in words)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) & ~_CLASS | k for w, k in zip(words, kinds)), np.uint64, len(words))
    bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
    index = np.insert(coded.indices.to_numpy()[real], bounds[1:], len(names))
    return np.append(names, np.uint64(_END)), index, bounds + np.arange(len(bounds))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token, and where each text's tokens begin (one more than texts)."""
    names, index, bounds = _coded(texts)
    return names[index], (names & np.uint64(_CLASS)).astype(np.uint8)[index], bounds


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in doc_ids], bool)


def _pairs(table: pa.Table):
    """A block's distinct pairs in order of word and context: words, pairs of each word, contexts, their classes, the token's pair, training counts."""
    names, index, bounds = _coded(table["text"].combine_chunks())
    # of the dictionary only what stands in a text, words that differ in case as one
    used = np.bincount(index, minlength=len(names)) > 0
    words, place = np.unique(names[used], return_inverse=True)
    word = place[(np.cumsum(used) - 1)[index]]
    del index
    # the token before a text's first is the end of the one before; the block's first token has the same context
    begin = np.searchsorted(words, np.uint64(_END))
    pair = word * len(words)
    pair[0] += begin
    pair[1:] += word[:-1]
    del word
    pair, which = np.unique(pair, return_inverse=True)
    trained = np.repeat(~held_out(table["doc_id"].to_pylist()), np.diff(bounds))
    counts = np.bincount(which[trained], minlength=len(pair))
    at = pair % len(words)
    contexts = words[at]
    return words, np.bincount(pair // len(words), minlength=len(words)), contexts, (contexts & np.uint64(_CLASS)).astype(np.uint8), which, counts, bounds


def _packed(values: np.ndarray, kind) -> bytes:
    """Numbers byte by byte of their places, compressed: most are small."""
    raw = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, size // width).T).view(kind).reshape(-1)


def _steps(places: np.ndarray) -> bytes:
    """Numbers by their differences (modulo 2^32)."""
    return _packed(np.diff(places.astype(np.uint32), prepend=np.uint32(0)), np.uint32)


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint32), dtype=np.uint32).astype(np.int64)


def _ascending(hashes: np.ndarray) -> bytes:
    """Ascending hashes by their differences, whose upper bits are mostly zero."""
    return _packed(np.diff(hashes, prepend=np.uint64(0)), np.uint64)


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


#: Of a block's pairs in a bucket: words, pairs of each, the contexts that occur, the pairs' places among these, training counts.
_ASKED = "bucket int, b int, words binary, pairs binary, contexts binary, places binary, counts binary"


def _opened(asked: pa.Table) -> pa.Table:
    """The same with hashes in full, and the contexts' classes."""
    words, contexts = ([_hashes(x) for x in asked[c].to_pylist()] for c in ("words", "contexts"))
    classes = [(x & np.uint64(_CLASS)).astype(np.uint8) for x in contexts]
    out = asked.drop_columns(["words", "contexts"])
    for name, values in (("words", words), ("contexts", contexts), ("classes", classes)):
        out = out.append_column(name, pa.array([x.tobytes() for x in values], pa.binary()))
    return out


def _bucket_cuts(words: np.ndarray, n: int) -> np.ndarray:
    """Where each of n (a power of two) equal ranges of hashes begins among the ascending words."""
    edges = np.array([(k << 64) // n for k in range(n)], np.uint64)
    return np.append(np.searchsorted(words, edges), len(words))


def _asked(blocks: DataFrame, n: int) -> DataFrame:
    def run(key, table):
        words, sizes, contexts, _, _, counts, _ = _pairs(table)
        cuts, ends = _bucket_cuts(words, n), np.concatenate(([0], np.cumsum(sizes)))
        rows = []
        for k in range(n):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                x, y = ends[a], ends[b]
                own, places = np.unique(contexts[x:y], return_inverse=True)
                packed = (_packed(sizes[a:b], np.int32), _ascending(own), _steps(places), _packed(counts[x:y], np.int32))
                rows.append((k, key[0].as_py(), _ascending(words[a:b]), *packed))
        names = [f.split()[0] for f in _ASKED.split(", ")]
        kinds = [pa.int32()] * 2 + [pa.binary()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return blocks.groupBy("b").applyInArrow(run, _ASKED)


def _arrays(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table[column].to_pylist()]


class _Bucket:
    """All pairs of a bucket's words with classes, merged over the blocks that ask for them: the restaurants from classes up."""

    def __init__(self, table: pa.Table):
        self.blocks = table["b"].to_pylist()
        get = lambda c, t: _arrays(table, c, t)
        self._merge(get("words", np.uint64), get("pairs", np.uint8), get("classes", np.uint8), get("counts", np.int32))

    def _merge(self, words: list, sizes: list, classes: list, counts: list) -> None:
        self.asked_words, self.asked_pairs = [len(w) for w in words], [len(c) for c in classes]
        self.words, word = np.unique(np.concatenate(words), return_inverse=True)
        self.asked = word
        of_pair = np.repeat(word, np.concatenate(sizes))
        keys, self.which = np.unique(of_pair * CLASSES + np.concatenate(classes), return_inverse=True)
        self.word, self.kind = keys // CLASSES, keys % CLASSES
        self.count = np.bincount(self.which, np.concatenate(counts), len(keys)).astype(np.int64)
        group = self.word * GROUPS + self.kind // (CLASSES // GROUPS)
        self.groups, self.group = np.unique(group, return_inverse=True)
        self.group_word, self.group_kind = self.groups // GROUPS, self.groups % GROUPS
        self.word_count = np.bincount(self.word, self.count, len(self.words)).astype(np.int64)
        self.of_pair = of_pair
        # everyone of a kind at one table
        self.tables = (self.count > 0).astype(np.int64)
        self._upwards(lambda customers, *_: (customers > 0).astype(np.int64))

    def _upwards(self, seat) -> None:
        """Sends one customer to the parent for each table, and seats them there."""
        self.group_count = np.bincount(self.group, self.tables, len(self.groups)).astype(np.int64)
        self.group_tables = seat(self.group_count, 1)
        self.root_count = np.bincount(self.group_word, self.group_tables, len(self.words)).astype(np.int64)
        self.root_tables = seat(self.root_count, 0)

    def totals(self) -> np.ndarray:
        """Customers and tables of every restaurant, then training tokens and distinct training words."""
        return np.concatenate([
            np.bincount(self.kind, self.count, CLASSES), np.bincount(self.kind, self.tables, CLASSES),
            np.bincount(self.group_kind, self.group_count, GROUPS), np.bincount(self.group_kind, self.group_tables, GROUPS),
            [self.root_count.sum(), self.root_tables.sum(), self.word_count.sum(), (self.word_count > 0).sum()],
        ]).astype(np.int64)

    def predictive(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of words at the root, in groups, and of pairs."""
        c_u, t_u, c_g, t_g = np.split(t[: 2 * (CLASSES + GROUPS)].astype(float), np.cumsum([CLASSES, CLASSES, GROUPS]))
        c_0, t_0, _, vocabulary = t[2 * (CLASSES + GROUPS) :].astype(float)
        d, s = DISCOUNT, STRENGTH
        root = (self.root_count - d[0] * self.root_tables + (s[0] + d[0] * t_0) / (vocabulary + 1)) / (s[0] + c_0)
        at = self.group_kind
        group = (self.group_count - d[1] * self.group_tables + (s[1] + d[1] * t_g[at]) * root[self.group_word]) / (s[1] + c_g[at])
        at = self.kind
        pair = (self.count - d[2] * self.tables + (s[2] + d[2] * t_u[at]) * group[self.group]) / (s[2] + c_u[at])
        return root, group, pair

    def sweep(self, t: np.ndarray, seed: tuple[int, int]) -> None:
        """Re-seats everyone, given all restaurants' tables."""
        rng = np.random.default_rng(seed)
        root, group, pair = self.predictive(t)
        self._below(pair, rng)
        _, t_u, _, t_g = np.split(t[: 2 * (CLASSES + GROUPS)].astype(float), np.cumsum([CLASSES, CLASSES, GROUPS]))
        t_0, vocabulary = float(t[-3]), float(t[-1])
        weight = (STRENGTH[2] + DISCOUNT[2] * t_u[self.kind]) * group[self.group]
        self.tables = seated(self.count, weight, DISCOUNT[2], rng)
        weights = {
            1: (STRENGTH[1] + DISCOUNT[1] * t_g[self.group_kind]) * root[self.group_word],
            0: np.full(len(self.words), (STRENGTH[0] + DISCOUNT[0] * t_0) / (vocabulary + 1)),
        }
        self._upwards(lambda customers, level: seated(customers, weights[level], DISCOUNT[level], rng))

    def _below(self, pair: np.ndarray, rng) -> None:
        """Re-seats what sends customers to the classes."""


class _Contexts(_Bucket):
    """With a restaurant for each context below that of its class."""

    def __init__(self, table: pa.Table):
        self.blocks = table["b"].to_pylist()
        get = lambda c, read, t: [read(x, t) for x in table[c].to_pylist()]
        names, kinds, places = get("contexts", np.frombuffer, np.uint64), get("classes", np.frombuffer, np.uint8), [_places(x) for x in table["places"].to_pylist()]
        counts = get("counts", _unpacked, np.int32)
        self._merge(get("words", np.frombuffer, np.uint64), get("pairs", _unpacked, np.int32), [k[p] for k, p in zip(kinds, places)], counts)
        self.contexts, context = np.unique(np.concatenate(names), return_inverse=True)
        starts = np.cumsum([0] + [len(x) for x in names])
        context = np.concatenate([context[a:][p] for a, p in zip(starts, places)])
        keys, first, self.asked_leaf = np.unique(self.of_pair * len(self.contexts) + context, return_index=True, return_inverse=True)
        self.context, self.parent = keys % len(self.contexts), self.which[first]
        self.leaf_count = np.bincount(self.asked_leaf, np.concatenate(counts), len(keys)).astype(np.int64)
        #: Tables and customers of each context over all buckets, set between sweeps.
        self.context_tables = self.context_count = np.zeros(len(self.contexts), np.int64)
        self._send((self.leaf_count > 0).astype(np.int64))
        self.tables = (self.count > 0).astype(np.int64)
        self._upwards(lambda customers, *_: (customers > 0).astype(np.int64))

    def _send(self, tables: np.ndarray) -> None:
        self.leaf_tables = tables
        self.count = np.bincount(self.parent, tables, len(self.kind)).astype(np.int64)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers that this bucket's words have in each context."""
        sums = [np.bincount(self.context, x, len(self.contexts)).astype(np.int64) for x in (self.leaf_tables, self.leaf_count)]
        return sums[0], sums[1]

    def _new_table(self, pair: np.ndarray) -> np.ndarray:
        return (STRENGTH[3] + DISCOUNT[3] * self.context_tables[self.context]) * pair[self.parent]

    def leaves(self, t: np.ndarray) -> np.ndarray:
        """Probabilities of words in their contexts."""
        seats = self.leaf_count - DISCOUNT[3] * self.leaf_tables + self._new_table(self.predictive(t)[2])
        return seats / (STRENGTH[3] + self.context_count[self.context])

    def _below(self, pair: np.ndarray, rng) -> None:
        self._send(seated(self.leaf_count, self._new_table(pair), DISCOUNT[3], rng))


def seated(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of so many customers of one dish each, seated one after another; weight: of a new table."""
    tables = (customers > 0).astype(np.int64)
    at, done, step = np.flatnonzero(customers > 1), 1, 1
    while len(at):
        t, w = tables[at], weight[at]
        n = np.minimum(customers[at] - done, step)
        middle = done + (n - 1) / 2
        new = w / (w + np.maximum(middle - discount * t, 1e-9))
        tables[at] = np.minimum(t + (rng.random(len(at)) < new if step == 1 else rng.binomial(n, new)), customers[at])
        done += step
        step = 1 if done < EXACT else done
        at = at[customers[at] > done]
    return tables


_SENT = "part int, bucket int, contexts binary, tables binary, customers binary, totals array<long>"
_REPLY = "bucket int, part int, sweep int, places binary, tables binary, customers binary, totals array<long>"
_UPPER = -1  # in the place of a part or bucket: totals of the upper restaurants


def _sampled(asked: pa.Table, replies: pa.Table, bucket: int, history: tuple):
    """The bucket after each sweep whose totals before it are known, with the totals after it where they are known."""
    model = _Contexts(_opened(asked))
    sweeps, parts = replies["sweep"].to_numpy(), replies["part"].to_numpy()
    for sweep in range(len(history) + 1):
        if sweep:
            model.sweep(history[sweep - 1], (bucket, sweep - 1))
        at = np.flatnonzero(sweeps == sweep)
        if len(at):
            order = at[np.argsort(parts[at])]
            read = lambda c, t: np.concatenate([_unpacked(replies[c][int(k)].as_py(), t) for k in order])
            model.context_tables = read("tables", np.int32).astype(np.int64)
            if not sweep:
                model.context_count = read("customers", np.int64)
        yield model


def _rows(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.Table:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def _sent(history: tuple, n: int):
    """What each bucket holds of the contexts after the latest sweep, by bucket of contexts, and its totals of the upper restaurants."""

    def run(key, asked, replies):
        rows, bucket = [], key[0].as_py()
        if asked.num_rows:
            for model in _sampled(asked, replies, bucket, history):
                pass
            rows.append((_UPPER, bucket, None, None, None, model.totals()))
            tables, customers = model.own()
            cuts = _bucket_cuts(model.contexts, n)
            # after the first round a context is known by its place in its bucket
            first = replies.filter(pc.equal(replies["sweep"], 0))
            places = dict(zip(first["part"].to_pylist(), first["places"].to_pylist()))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                names = places[k] if history else _ascending(model.contexts[a:b])
                rows.append((k, bucket, names, _packed(tables[a:b], np.int32), None if history else _packed(customers[a:b], np.int64), None))
        return _rows(rows, _SENT, [pa.int32()] * 2 + [pa.binary()] * 3 + [pa.list_(pa.int64())])

    return run


def _added(sweep: int):
    """A bucket of contexts adds up what buckets of words hold of them and answers each."""

    kinds = [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.int64())]

    def run(key, table):
        if key[0].as_py() == _UPPER:
            return _rows([(_UPPER, _UPPER, sweep, None, None, None, np.sum(table["totals"].to_pylist(), axis=0))], _REPLY, kinds)
        if sweep:
            places = [_places(x) for x in table["contexts"].to_pylist()]
        else:
            names = [_hashes(x) for x in table["contexts"].to_pylist()]
            _, flat = np.unique(np.concatenate(names), return_inverse=True)
            places = np.split(flat, np.cumsum([len(x) for x in names])[:-1])
        add = lambda c, t: np.bincount(np.concatenate(places), np.concatenate([_unpacked(x, t) for x in table[c].to_pylist()])).astype(np.int64)
        tables, customers = add("tables", np.int32), None if sweep else add("customers", np.int64)
        rows = []
        for bucket, at in zip(table["bucket"].to_pylist(), places):
            own = None if sweep else _steps(at), _packed(tables[at], np.int32), None if sweep else _packed(customers[at], np.int64)
            rows.append((bucket, key[0].as_py(), sweep, *own, None))
        return _rows(rows, _REPLY, kinds)

    return run


def sampled(asked: DataFrame, n: int) -> tuple[list[np.ndarray], DataFrame]:
    """Totals of the upper restaurants before the first sweep and after each; for each of n buckets those of the contexts it holds."""
    history: list[np.ndarray] = []
    replies = asked.sparkSession.createDataFrame([], _REPLY)
    name = None
    for sweep in range(SWEEPS + 1):
        sent = asked.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_sent(tuple(history), n), _SENT)
        name = _bucketed(sent.groupBy("part").applyInArrow(_added(sweep), _REPLY), n, "bucket", name)
        replies = asked.sparkSession.table(name).filter(F.col("bucket") != _UPPER)
        upper = asked.sparkSession.table(name).filter((F.col("bucket") == _UPPER) & (F.col("sweep") == sweep)).select("totals").first()
        history.append(np.array(upper.totals, np.int64) if upper else np.zeros(2 * (CLASSES + GROUPS) + 4, np.int64))
    return history, replies


def _answers(asked: DataFrame, history: list[np.ndarray], replies: DataFrame) -> DataFrame:
    """b, bucket, and for the block's pairs of the bucket log10 probabilities, for its words their counts."""

    def run(key, table, found):
        rows, bucket = [], key[0].as_py()
        if table.num_rows:
            total, used = 0.0, 0
            for k, model in enumerate(_sampled(table, found, bucket, tuple(history[:-1]))):
                if k > BURN_IN:
                    total = total + model.leaves(history[k])
                    used += 1
            logs = np.log10(total / used).astype(np.float32)[model.asked_leaf]
            counts = model.word_count[model.asked].astype(np.int64)
            ends, word_ends = np.cumsum(model.asked_pairs), np.cumsum(model.asked_words)
            scores = [_packed(logs[e - n : e], np.float32) for e, n in zip(ends, model.asked_pairs)]
            known = [_packed(counts[e - n : e], np.int64) for e, n in zip(word_ends, model.asked_words)]
            rows = [(b, bucket, x, y) for b, x, y in zip(model.blocks, scores, known)]
        return _rows(rows, _ANSWER, [pa.int32()] * 2 + [pa.binary()] * 2)

    return asked.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(run, _ANSWER)


_ANSWER = "b int, bucket int, scores binary, counts binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(blocks: DataFrame, answers: DataFrame, n_tokens: int, n_words: int) -> DataFrame:
    def score(table, found):
        _, sizes, _, _, which, _, bounds = _pairs(table)
        order = np.argsort(found["bucket"].to_numpy())
        join = lambda c, t: np.concatenate([_unpacked(found[c][int(k)].as_py(), t) for k in order])
        logs = join("scores", np.float32).astype(np.float64)[which]
        counts = np.repeat(join("counts", np.int64), sizes)[which]
        base = np.log10((counts + 1.0) / (n_tokens + n_words + 1))
        starts, ids = bounds[:-1], table["doc_id"].to_pylist()
        sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base, logs)]
        out = held_out(ids)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out), "n_tokens": pa.array(np.diff(bounds)),
            "n_known": pa.array(sums[0]), "train_tokens": pa.array([n_tokens] * len(ids), pa.int64()),
            "base_score": pa.array(sums[1]), "score": pa.array(sums[2]),
        })

    def job(key, table, found):
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in _KINDS], [f.split()[0] for f in _RESULT.split(", ")])
        return score(table, found)

    return blocks.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(job, _RESULT)


_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def scores(docs: DataFrame) -> DataFrame:
    """One row per document: held out or not, tokens, known tokens, unigram base score and the model's score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, size // BLOCK_TEXT)
    buckets = 1 << max(4, (size // BLOCK_TEXT).bit_length())
    table = docs.sparkSession.table
    blocks = table(_bucketed(docs.withColumn("b", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n, "b"))
    asked = table(_bucketed(_asked(blocks, buckets), buckets, "bucket"))
    history, replies = sampled(asked, buckets)
    return _scored(blocks, _answers(asked, history, replies), int(history[0][-2]), int(history[0][-1]))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
