"""Language-model scores with Brown class-based bigrams.

Exchange clustering assigns every word of the training texts to a class:

1. Words are 64-bit hashes; one Spark aggregation counts them all.
2. Words that hold at least ``SHARE`` of all tokens and occur ``LEAST`` times take part in the sweeps: at most 1 / ``SHARE``
   words, however large the corpus, which bounds what a sweep broadcasts. The counts of their neighbours, on both sides, stay
   in a table with a row a word. The ``SEEDS`` most frequent are clustered first, on the driver; then all others are placed,
   and sweeps move words: each task weighs its words' classes of neighbours against the class bigrams of the whole corpus.
   A sweep's moves are taken together, as in distributed word clustering (Uszkoreit and Brants, 2008), and kept only if the
   likelihood of the whole corpus rises; else fewer words move at a time.
3. Every rarer word takes the class that raises the likelihood most given its neighbours' classes: the same step, once.

A word's probability is its class's, given the class before it, times its share of the class:

    P(w | before) = P(class(w) | class(before)) * (c(w) + 0.5) / mass(class(w))

with transitions smoothed towards the classes' own shares. A class's mass also holds a slot for unknown words, half of its
words seen once and a half. An unknown word has no class: its probability is summed over all classes' slots, and what
follows it is predicted by the classes of words seen once. The probabilities of all words and the slots sum to one.

Defined results: a null text is empty and consists of the end token; words of any length count, and repeated rows count as
often as they occur; with no training text every count is nil. A null id counts as the empty text for the split into
training and held-out texts. Equal gains go to the class of the smaller number; equal counts are ordered by hash. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, crc_fold, keep, slices, utf8

#: Least occurrences, and least share of all tokens, of words that take part in the sweeps (12 bytes each in a broadcast).
LEAST, SHARE = 2, 2e-7
CLASSES, SEEDS, SWEEPS, PRIOR = 64, 512, 8, 20.0
#: A sweep that raises the likelihood by less than this part is the last.
GAIN = 5e-4
#: Tokens that a task folds at a time.
WINDOW = 1 << 22
#: Tokens that are looked up at a time.
STEP = 1 << 18
#: Neighbours in a row of a frequent word, more or less; words that occur half as often have one row.
LIST = 1 << 17
#: Words whose moves are weighed at a time.
BLOCK = 512
#: Groups that words are dealt out to with their neighbours; each group puts its words' counts together.
GROUPS = 4096
#: Codes of classes beside the ordinary ones: the end of a text, and words without a class.
END, NONE, ALL = CLASSES, CLASSES + 1, CLASSES + 2
END_HASH = xxhash.xxh64_intdigest(b"\n")  # no word contains white space


def hashes(text: bytes) -> np.ndarray:
    """The text's words as hashes, without the end."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of many texts in a row, each text behind an end and the last before one."""
    end = np.array([END_HASH], np.uint64)
    held, size = [end], 1
    for part in slices(batches):
        for text in part.column("_text").to_pylist():
            held += [hashes(text), end]
            size += len(held[-2]) + 1
        if size > WINDOW:
            yield np.concatenate(held)
            held, size = [end], 1
    if size > 1:
        yield np.concatenate(held)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs; sorts in place."""
    values.sort()
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.diff(np.append(first, len(values)))


def count_words(texts: DataFrame) -> DataFrame:
    """``h, n`` over the ``_text`` bytes, ends included; folded in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens in _runs(batches):
            h, n = _counted(tokens[1:])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return arrow_pass(texts.select("_text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class Words:
    """Numbers of the words of the sweeps, by falling count; ``size`` is the end's, ``size + 1`` any other word's."""

    def __init__(self, h: np.ndarray):
        h = h.astype(np.int64).view(np.uint64)
        self.size = len(h)
        order = np.argsort(np.append(h, END_HASH), kind="stable")
        self.keys, self.ids = np.append(h, np.uint64(END_HASH))[order], order.astype(np.int32)
        # Hashes are spread evenly, so about one key begins with the same leading bits.
        bits = max(1, self.size.bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        found = np.empty(len(h), np.int32)
        for at in range(0, len(h), STEP):
            part = h[at : at + STEP]
            near = np.minimum(self.first[(part >> self.shift).astype(np.intp)], self.size)
            late = np.flatnonzero(self.keys[near] < part)
            while len(late):
                late = late[near[late] < self.size]
                near[late] += 1
                late = late[self.keys[near[late]] < part[late]]
            found[at : at + STEP] = np.where(self.keys[near] == part, self.ids[near], np.int32(self.size + 1))
        return found


def _bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All binary values of a column as one array, and how long each is."""
    if not len(column):
        return np.empty(0, kind), np.empty(0, np.int64)
    _, offsets, held = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _starts(values: np.ndarray) -> np.ndarray:
    """Where stretches of equal values begin, and the end of the last."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)]), len(values))


def neighbours(texts: DataFrame, words: Words, frequent: int = 0) -> DataFrame:
    """``w, v, n``: each word with its neighbours and how often they meet; ``-1 - v`` stands for ``v`` on the left.

    The end and the other words have right neighbours only. The ``frequent`` first words, the end and the other words have
    several rows, with part of their neighbours each, so that a row has some ``LIST`` entries whatever the corpus.

    ``v`` are 32-bit integers and ``n`` doubles, in a row as bytes: sweeps read them many times. Tasks fold what they read and
    deal it out to ``GROUPS`` by word (and part) in one exchange, a row a group.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words)
    parts = max(1, -(-2 * (words.size + 2) // LIST))
    bits = (words.size + 1).bit_length()  # 5 million words take 23: a group, a word and a neighbour are one 64-bit integer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        low = (1 << bits) - 1
        for tokens in _runs(batches):
            ids = words(tokens)
            del tokens
            for on_left in (False, True):
                w, v = (ids[1:], ids[:-1]) if on_left else (ids[:-1], ids[1:])
                if on_left:
                    own = w < words.size
                    w, v = w[own], v[own]
                several = (w < frequent) | (w >= words.size)
                group = w.astype(np.int64)
                group[several] += 61 * ((v[several].astype(np.int64) * 40503 >> 4) % parts)  # parts of one word go to different groups
                code = group % GROUPS
                code <<= bits
                code |= w
                code <<= bits
                code |= v
                del group, w, v
                code, n = _counted(code)
                ends = _starts(code >> (2 * bits))
                v = (code & low).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((code[ends[:-1]] >> (2 * bits)).astype(np.int32)), _bytes((code >> bits & low).astype(np.int32), ends), _bytes(-1 - v if on_left else v, ends), _bytes(n.astype(np.int32), ends)],
                    names=["g", "w", "v", "n"],
                )

    def whole(group: pa.Table) -> pa.Table:
        w, v, n = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int32) for c in "wvn")
        code = (w.astype(np.int64) << 32) + v
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = _starts(code)[:-1]
        code, n = code[at], np.add.reduceat(n[order].astype(float), at)
        w = (code + (1 << 31)) >> 32
        ends = _starts(w)
        return pa.table({"w": pa.array(w[ends[:-1]].astype(np.int32)), "v": _bytes((code - (w << 32)).astype(np.int32), ends), "n": _bytes(n, ends)})

    met = arrow_pass(texts.select("_text"), run, "g int, w binary, v binary, n binary")
    return met.groupBy("g").applyInArrow(whole, "w int, v binary, n binary")


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """Log likelihood of the class bigrams, up to a constant of the corpus."""
    return float(_x_log_x(joint).sum() - _x_log_x(joint.sum(1)).sum() - _x_log_x(joint.sum(0)).sum())


def gains(into: np.ndarray, out: np.ndarray, own: np.ndarray, of: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """What each word's being in each class adds to the likelihood, each word alone taken out of its class ``of``.

    ``into`` and ``out`` count a word's neighbours of each class on the left and right, ``own`` its meetings with itself.
    Only cells of neighbours that a word has change, so only those are computed.
    """
    size, k = into.shape
    total = np.zeros((size, k))
    at_word = np.arange(size)
    for near, other, cells in ((into, out, joint), (out, into, joint.T)):
        w, i = np.nonzero(near)
        if not len(w):
            continue
        x = cells[i]
        x[np.arange(len(w)), of[w]] -= near[w, i]
        home = np.flatnonzero(i == of[w])
        x[home] -= other[w[home]]
        x[home, of[w[home]]] -= own[w[home]]
        change = _x_log_x(x + near[w, i][:, None]) - _x_log_x(x)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        total[w[first]] += np.add.reduceat(change, first, axis=0)
    diagonal = np.repeat(np.diagonal(joint)[None, :], size, 0)
    diagonal[at_word, of] -= into[at_word, of] + out[at_word, of] + own
    base = _x_log_x(diagonal)
    total += _x_log_x(diagonal + into + out + own[:, None]) + base - _x_log_x(diagonal + into) - _x_log_x(diagonal + out)
    for near, margin in ((out, joint.sum(1)), (into, joint.sum(0))):
        more = near.sum(1) + own
        have = np.repeat(margin[None, :], size, 0)
        have[at_word, of] -= more
        total -= _x_log_x(have + more[:, None]) - _x_log_x(have)
    return total


def best_classes(into: np.ndarray, out: np.ndarray, own: np.ndarray, of: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class each word moves to; its own unless another gains more, any if it has none."""
    found = np.array(of)
    for at in range(0, len(of), BLOCK):
        part = slice(at, at + BLOCK)
        gain = gains(into[part], out[part], own[part], of[part], joint)
        best = gain[:, :CLASSES].argmax(1)
        row = np.arange(len(best))
        better = (of[part] == NONE) | (gain[row, best] > gain[row, of[part]] + 1e-9)
        found[part] = np.where(better, best, of[part])
    return found


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of a few types, the last of which is the end, from their matrix of pair counts; one move at a time.

    The seeds of the clustering, and what its distributed sweeps are tested against.
    """
    t = len(pairs) - 1
    of = np.append(np.arange(t) % classes, END)
    pairs = pairs.astype(float)
    member = np.zeros((t + 1, ALL))
    member[np.arange(t + 1), of] = 1
    joint = member.T @ pairs @ member
    for _ in range(sweeps):
        before = likelihood(joint)
        for w in range(t):
            into, out, own = member.T @ pairs[:, w], pairs[w] @ member, pairs[w, w]
            into[of[w]] -= own
            out[of[w]] -= own
            gain = gains(into[None], out[None], np.array([own]), of[w : w + 1], joint)[0]
            a, b = of[w], int(gain[:classes].argmax())
            if gain[b] > gain[a] + 1e-9:
                for c, sign in ((a, -1), (b, 1)):
                    joint[:, c] += sign * into
                    joint[c, :] += sign * out
                    joint[c, c] += sign * own
                member[w, a], member[w, b], of[w] = 0, 1, b
        if likelihood(joint) - before <= GAIN * abs(before):
            break
    return of


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of ``neighbours``, how many neighbours each has, these, and their counts."""
    v, size = _values(part.column("v"), np.int32)
    return part.column("w").to_numpy(), size, v, _values(part.column("n"), np.float64)[0]


def _side_codes(of: np.ndarray) -> np.ndarray:
    """Classes by neighbour; those on the left, which count from the end of the array, have numbers of their own."""
    return np.concatenate([of, of[::-1] + np.uint8(ALL)])


def _sides(part: pa.RecordBatch, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of ``neighbours``, with the counts of their neighbours' classes on the left and right, and their own."""
    w, size, v, n = _lists(part)
    cell = np.repeat(np.arange(len(w)) * (2 * ALL), size)
    cell += codes[v]
    counts = np.bincount(cell, n, len(w) * 2 * ALL)
    same = np.flatnonzero((v ^ (v >> 31)) == np.repeat(w, size))
    np.subtract.at(counts, cell[same], n[same])
    same = same[v[same] >= 0]
    own = np.bincount(cell[same] // (2 * ALL), n[same], len(w))
    counts = counts.reshape(-1, 2, ALL)
    return w, counts[:, 1], counts[:, 0], own


def class_pairs(near: DataFrame, of: np.ndarray) -> np.ndarray:
    """How often each class follows each in the whole corpus."""
    shared = near.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = shared.value, np.zeros(ALL * 2 * ALL)
        codes, rows = _side_codes(of), of.astype(np.int64) * (2 * ALL)
        for part in batches:
            w, size, v, n = _lists(part)
            total += np.bincount(np.repeat(rows[w], size) + codes[v], n, len(total))
        yield _cells(total.reshape(ALL, 2, ALL)[:, 0])

    return _matrix(arrow_pass(near, run, "pair int, n double"))


def _cells(total: np.ndarray) -> pa.RecordBatch:
    hit = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total.ravel()[hit].astype(float))], names=["pair", "n"])


def _matrix(cells: DataFrame) -> np.ndarray:
    """The sum of tasks' matrices: at most ``ALL`` x ``ALL`` cells reach the driver."""
    found = cells.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(ALL * ALL)
    total[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return total.reshape(ALL, ALL)


def moves(near: DataFrame, words: int, of: np.ndarray, joint: np.ndarray, every: int, turn: int, frequent: int = 0) -> np.ndarray:
    """``of`` after one sweep in which one of ``every`` words may move; words without a class all get one.

    Of the ``frequent`` first words, which have several rows, the classes of neighbours are added up before.
    """
    shared = near.sparkSession.sparkContext.broadcast((of, joint))

    def moved(w: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        of, joint = shared.value
        mine = (w < words) & ((of[w] == NONE) | ((w * 40503 >> 4) % every == turn % every))
        found = best_classes(into[mine], out[mine], own[mine], of[w[mine]].astype(np.int64), joint)
        new = found != of[w[mine]]
        return pa.RecordBatch.from_arrays([pa.array(w[mine][new].astype(np.int32)), pa.array(found[new].astype(np.int16))], names=["w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _side_codes(shared.value[0])
        for part in batches:
            yield moved(*_sides(part, codes))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _side_codes(shared.value[0])
        for part in batches:
            w, into, out, own = _sides(part, codes)
            cells = np.hstack([into, out, own[:, None]])
            row, cell = np.nonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(w[row]), pa.array(cell.astype(np.int32)), pa.array(cells[row, cell])], names=["w", "cell", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("cell")
            cells = np.zeros((part.num_rows, 2 * ALL + 1))
            cells[np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = part.column("n").flatten().to_numpy()
            yield moved(part.column("w").to_numpy(), cells[:, :ALL], cells[:, ALL:-1], cells[:, -1])

    rows = arrow_pass(near.where(F.col("w") >= frequent) if frequent else near, run, "w int, c smallint")
    if frequent:
        added = arrow_pass(near.where(F.col("w") < frequent), partial, "w int, cell int, n double").groupBy("w", "cell").agg(F.sum("n").alias("n"))
        added = added.groupBy("w").agg(F.collect_list("cell").alias("cell"), F.collect_list("n").alias("n"))  # 2 * ALL + 1 cells at most
        rows = rows.unionByName(arrow_pass(added, whole, "w int, c smallint"))
    found = _pandas(rows)  # at most 1 / SHARE rows of 6 bytes
    of = np.array(of)
    of[found["w"].to_numpy(np.int64)] = found["c"].to_numpy()
    return of


def _pandas(rows: DataFrame):
    """A table of bounded size on the driver, by Arrow columns instead of row objects."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.pyspark.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return rows.toPandas()
    finally:
        conf.set(name, before)


def _seeds(near: DataFrame, words: int) -> np.ndarray:
    """Classes of the most frequent words; the others have none yet."""
    of = np.full(words + 2, NONE, np.uint8)
    of[words] = END
    few = min(SEEDS, words)
    if few:

        def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                w, size, v, n = _lists(part)
                mine = ((v >= 0) & (v < few)) | (v == words)
                w, v = np.repeat(w, size)[mine], v[mine]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(x == words, few, x).astype(np.int32)) for x in (w, v)] + [pa.array(n[mine])], names=["w", "v", "n"])

        rows = _pandas(arrow_pass(near.where((F.col("w") < few) | (F.col("w") == words)), among, "w int, v int, n double"))
        pairs = np.zeros((few + 1, few + 1))
        pairs[rows["w"].to_numpy(), rows["v"].to_numpy()] = rows["n"].to_numpy()
        of[:few] = exchange(pairs)[:few]
    return of


def cluster(near: DataFrame, words: int, frequent: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A class for each of ``words`` words, and the class bigrams of the corpus."""
    of = _seeds(near, words)
    of = moves(near, words, of, class_pairs(near, of), 1, 0, frequent)
    joint = class_pairs(near, of)
    every = 2
    for turn in range(SWEEPS):
        tried = moves(near, words, of, joint, every, turn, frequent)
        if np.array_equal(tried, of):
            break
        after = class_pairs(near, tried)
        gained = likelihood(after) - likelihood(joint)
        if gained <= 0:
            every *= 2
            continue
        of, joint = tried, after
        if gained < GAIN * abs(likelihood(joint)):
            break
    return of, joint


def place_rest(texts: DataFrame, words: Words, of: np.ndarray, joint: np.ndarray) -> DataFrame:
    """``h, n, c``: the other words of the training texts, how often they occur, and the class they take from their neighbours."""
    shared = texts.sparkSession.sparkContext.broadcast((words, of, joint))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of, _ = shared.value
        for tokens in _runs(batches):
            ids = words(tokens)
            at = np.flatnonzero(ids == words.size + 1)
            code = of[ids[at - 1]].astype(np.int32) * ALL + of[ids[at + 1]]
            h, code, n = _folded(tokens[at], code)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(code), pa.array(n)], names=["h", "code", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = shared.value[2]

        def classes(row: np.ndarray, code: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
            into = np.bincount(row * ALL + code // ALL, n, size * ALL).reshape(-1, ALL)
            out = np.bincount(row * ALL + code % ALL, n, size * ALL).reshape(-1, ALL)
            return best_classes(into, out, np.zeros(size), np.full(size, NONE), joint)

        every = np.arange(ALL * ALL)
        of_one = classes(every, every, np.ones(ALL * ALL), ALL * ALL)  # for words seen once, most of these, by their neighbours
        for part in batches:
            lists = part.column("code")
            size, each = part.num_rows, np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(size), each)
            code, n = lists.flatten().to_numpy(), part.column("n").flatten().to_numpy()
            total = np.bincount(row, n, size).astype(np.int64)
            once = total == 1
            c = np.empty(size, np.int64)
            c[once] = of_one[code[once[row]]]
            more = ~once[row]
            c[~once] = classes((np.cumsum(~once) - 1)[row[more]], code[more], n[more], int((~once).sum()))
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(total), pa.array(c.astype(np.int16))], names=["h", "n", "c"])

    met = arrow_pass(texts.select("_text"), meet, "h bigint, code int, n bigint")
    # One exchange by word; a word's list holds each pair of classes once, and no word of this table is frequent.
    folded = met.repartition("h").groupBy("h", "code").agg(F.sum("n").alias("n"))
    return arrow_pass(folded.groupBy("h").agg(F.collect_list("code").alias("code"), F.collect_list("n").alias("n")), place, "h bigint, n bigint, c smallint")


def _folded(h: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a hash and a code, and how often each occurs."""
    order = np.lexsort((code, h))
    h, code = h[order], code[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (code[1:] != code[:-1]))[: len(h)])
    return h[first], code[first], np.diff(np.append(first, len(h)))


class Model:
    """Totals, the words of the sweeps with their counts and classes, and the masses of classes."""

    def __init__(self, tokens: int, distinct: int, words: Words, counts: np.ndarray, end: int, of: np.ndarray, mass: np.ndarray, once: np.ndarray):
        self.tokens, self.divisor = tokens, tokens + 0.5 * (distinct + 1)
        self.words, self.of, self.end = words, of, end
        self.mass, self.once = mass, once
        self.slot = 0.5 + 0.5 * once  # what unknown words have of each class
        count = np.concatenate([counts, [end, 0]]).astype(float)
        self.base = np.log10((count + 0.5) / self.divisor)
        self.share = np.log10((count + 0.5) / mass[of])
        self.share[-1] = 0.0

    def transitions(self, joint: np.ndarray) -> np.ndarray:
        """log10 P(class | class before); the last column is an unknown word's, the last row what follows one."""
        k = CLASSES + 1
        inner, mass = joint[:k, :k], self.mass[:k]
        given = (inner + PRIOR * mass / mass.sum()) / (inner.sum(1, keepdims=True) + PRIOR)
        mixed = (self.once[:k] + 1e-9) / (self.once[:k] + 1e-9).sum()
        given = np.vstack([given, mixed @ given])
        return np.log10(np.hstack([given, (given @ (self.slot / self.mass)[:k])[:, None]]))


def learn(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model but for its transitions, and ``h, n, c`` of the words that took no part in the sweeps."""
    counts = keep(count_words(texts), "word-counts")
    signed_end = int(np.uint64(END_HASH).astype(np.int64))
    tokens, distinct, end = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("h") == signed_end, F.col("n"))), F.lit(0))).first()
    least = max(LEAST, math.ceil(SHARE * tokens))
    often = _pandas(counts.where((F.col("n") >= least) & (F.col("h") != signed_end))).sort_values(["n", "h"], ascending=[False, True])
    words, n = Words(often["h"].to_numpy(np.int64)), often["n"].to_numpy(np.int64)
    frequent = int((n > LIST // 2).sum())
    near = keep(neighbours(texts, words, frequent), "word-neighbours")
    of, joint = cluster(near, words.size, frequent)
    rest = keep(place_rest(texts, words, of, joint), "rare-words")
    mass, once = np.full(ALL, 0.5), np.zeros(ALL)
    np.add.at(mass, of[: words.size], n + 0.5)
    mass[END] += end + 0.5 * (end > 0)
    for r in rest.groupBy("c").agg(F.sum(F.col("n") + 0.5).alias("m"), F.sum((F.col("n") == 1).cast("bigint")).alias("o")).collect():  # a row a class
        mass[r["c"]] += r["m"]
        once[r["c"]] += r["o"]
    return Model(tokens, distinct, words, n, end, of, mass + 0.5 * once, once), rest


_CHAIN = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("doc_id", pa.int64()), ("train", pa.bool_()), ("chain", pa.binary()), ("base", pa.float64()), ("share", pa.float64())])


def _batch(rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of the schema above; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in _CHAIN], schema=_CHAIN)


def chains(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """``doc_id, train, chain, n_known, base, share`` of every text: its tokens' classes, a byte each, and sums of logs.

    The words of the sweeps are looked up; the others, folded within each text, join the table of rarer words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        first_key = TaskContext.get().partitionId() << 33
        for part in slices(batches):
            found = [hashes(x) for x in part.column("_text").to_pylist()]
            size = np.array([len(x) for x in found], np.int64)
            starts = np.cumsum(size) - size
            h, of_text = np.concatenate(found), np.repeat(np.arange(len(size)), size)
            ids = model.words(h)
            rare = np.flatnonzero(ids == model.words.size + 1)
            codes = np.full(len(h) + len(size), END, np.uint8)
            codes[np.arange(len(h)) + of_text] = model.of[ids]
            logs = model.base[ids]
            logs[rare] = 0.0
            keys = first_key + np.arange(len(size))
            # a text's own row goes with any word's: its hash is spread, and nothing of the join is taken for it
            spread = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield _batch(
                len(size), key=pa.array(keys), h=pa.array(spread), doc_id=part.column("doc_id"), train=part.column("_train"), chain=_bytes(codes, np.append(starts, len(h)) + np.arange(len(size) + 1)),
                base=pa.array(np.bincount(of_text, logs, len(size)) + model.base[-2]), share=pa.array(np.bincount(of_text, model.share[ids], len(size)) + model.share[-2]),
            )
            if len(rare):
                rare = rare[np.lexsort((h[rare], of_text[rare]))]
                own, text = h[rare], of_text[rare]
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1])))
                at = pa.ListArray.from_arrays(pa.array(np.append(first, len(rare)).astype(np.int32)), pa.array((rare - starts[text]).astype(np.int32)))
                yield _batch(len(first), key=pa.array(keys[text[first]]), h=pa.array(own[first].view(np.int64)), at=at)
            first_key += len(size)

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_train"), utf8().alias("_text"))
    rows = arrow_pass(ids, look_up, "key bigint, h bigint, at array<int>, doc_id bigint, train boolean, chain binary, base double, share double")
    joined = rows.join(rest, "h", "left")
    found = joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.max("chain").alias("chain"), F.max("base").alias("base"), F.max("share").alias("share"),
        F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(NONE)).cast("smallint").alias("c")))).alias("rare"),
    )

    def weave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        mass = np.append(model.mass[: CLASSES + 1], 1.0)
        for part in batches:
            if not part.num_rows:
                continue
            rows, lists = part.num_rows, part.column("rare")
            codes, size = _values(part.column("chain"), np.uint8)
            size, codes = size.astype(np.int64), codes.copy()
            starts = np.cumsum(size) - size
            spots, n, c = lists.flatten().flatten()
            text = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
            times, n, c = np.diff(spots.offsets.to_numpy()), n.to_numpy().astype(float), c.to_numpy()
            codes[np.repeat(starts[text], times) + spots.flatten().to_numpy()] = np.repeat(c, times)
            base = part.column("base").to_numpy() + np.bincount(text, times * np.log10((n + 0.5) / model.divisor), rows)
            share = part.column("share").to_numpy() + np.bincount(text, np.where(c == NONE, 0.0, times * np.log10((n + 0.5) / mass[c])), rows)
            unknown = np.bincount(text, np.where(c == NONE, times, 0), rows).astype(np.int64)
            known = size - (model.end == 0) - unknown
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("train"), _bytes(codes, np.append(starts, len(codes))), pa.array(known), pa.array(base), pa.array(share)], names=["doc_id", "train", "chain", "n_known", "base", "share"])

    return arrow_pass(found.drop("key"), weave, "doc_id bigint, train boolean, chain binary, n_known bigint, base double, share double")


def chain_pairs(rows: DataFrame) -> np.ndarray:
    """How often each class follows each in the chains; an end stands before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALL * ALL)
        for part in batches:
            codes = np.append(np.uint8(END), _values(part.column("chain"), np.uint8)[0]).astype(np.int64)  # each chain ends with an end
            total += np.bincount(codes[:-1] * ALL + codes[1:], minlength=ALL * ALL)
        yield _cells(total)

    return _matrix(arrow_pass(rows.select("chain"), run, "pair int, n double"))


def score(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of documents with a ``_train`` flag.

    Transitions are counted over the chains of those that have it; perplexity is per token, the end included.
    """
    rows = keep(chains(docs, model, rest), "class-chains")
    shared = docs.sparkSession.sparkContext.broadcast(model.transitions(chain_pairs(rows.where("train"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for part in batches:
            if not part.num_rows:
                continue
            codes, size = _values(part.column("chain"), np.uint8)
            codes = np.append(np.uint8(END), codes)
            found = np.add.reduceat(logs[codes[:-1], codes[1:]], np.cumsum(size) - size)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, "links"])

    fields = "doc_id bigint, train boolean, chain binary, n_known bigint, base double, share double, links double"
    total, size = F.col("share") + F.col("links"), F.length("chain").cast("bigint")
    return arrow_pass(rows, run, fields).select(
        "doc_id", "train", size.alias("n_tokens"), "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / size).alias("perplexity"),
    )


def held_out_scores(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """Learn from the documents outside fold ``held`` and score all."""
    split = docs.select("doc_id", "text", (crc_fold(folds) != held).alias("_train"))
    model, rest = learn(split.where("_train").select(utf8().alias("_text")))
    found = score(split, model, rest)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
