"""Alignment of two tokenizers' tokens over the same text.

Text is a space and the document's text. It is cut where both a byte-level vocabulary (A) and a sentence-piece vocabulary (B) surely
end a token: before a space or another white character that follows none, behind a lone white character, and between letters, digits and
other marks of ASCII, unless a piece of B holds the two characters side by side. The units between the cuts repeat: tokenising, in Arrow
batches, gives the distinct units of a few MB of text with either vocabulary's ids, and each document as the numbers of its units.

Which tokens form a group depends only on the byte offsets behind the tokens, the unit's shape, and shapes are few. Spark's higher-order
functions align each distinct shape: `array_intersect` of the two arrays of ends gives the places where both end a token, and whether a
token ends there is looked up in an array with an entry for each byte, so the work is linear. Units of many tokens are aligned one by one
with their ids, down to their pairs (`transform` and `sequence` cut the tokens into groups and pair those of a group as links). An array
that a lambda reads is bound to a variable first (`let`): what stands inside a lambda itself would be computed again for each element.
In Arrow batches again, groups are written out with the units' ids and documents are put together from their units.

Links between an id of A and an id of B are counted over the corpus by the documents that hold them. A document keeps its distinct
id pairs with their number of occurrences, so a long group of few ids stays small. The documents' pairs are written once, as a table that
both the count and the lookup read. The counts are broadcast where they number BROADCAST_PAIRS at most (they are counted first), else
joined in SALTS slices, so that a pair which most documents hold is spread over tasks.

Defined results: a null or empty text, and one whose tokens' bytes differ from space and text for either vocabulary (as
U+2581 makes them differ), has no tokens, zeros throughout and an empty groups string; rows with equal or null ids are aligned
each on their own and count as documents of their own; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.llm.bpe import Decoder, encoder
from evimap.llm.common import let, materialise, new_folder, slices, utf8

#: Pairs of ids whose counts may be broadcast: 24 bytes each, some 50 MB as a hash table.
BROADCAST_PAIRS = 1 << 20
#: Slices of the join where there are more.
SALTS = 16
#: Bytes of text whose distinct units are tokenised and aligned together.
SLICE_BYTES = 2 << 20
#: Short units of text whose tokens a worker keeps; of a full memo the half that was met most often stays. It bounds memory only.
MEMO = 200_000
#: Pairs of tokens, of either vocabulary, up to which a unit is aligned by its shape. Others are aligned one by one.
SHORT = 256
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Bits of an id in the numbers of pairs that are sorted.
ID_BITS = 20
_UNIT = "struct<a:array<int>,a_ends:array<int>,b:array<int>,b_ends:array<int>>"
_TOKENS = {"shape": "array<int>", "shapes": "array<struct<a_ends:array<int>,b_ends:array<int>>>", "long": f"array<{_UNIT}>", "rest": "binary"}
_DOCUMENTS = {k: "bigint" for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"groups": "string", "a": "array<int>", "b": "array<int>", "times": "array<bigint>"}


def _schema(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes, dtype=np.int64)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.repeat(starts - _starts(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_starts(sizes).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists one after the other, and n + 1 offsets among them."""
    at = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.flatten()), at - at[0]


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def _taken(table: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a table's entries one after the other, and n + 1 offsets."""
    if not len(numbers):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = table.take(pa.array(numbers)).buffers()
    at = np.frombuffer(at, np.int64)[: len(numbers) + 1]
    return np.frombuffer(data, np.uint8)[: at[-1]] if at[-1] else np.empty(0, np.uint8), at


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in batches]) for k in range(batches[0].num_columns)], schema=batches[0].schema)


def _packed(columns: dict[str, pa.Array]) -> pa.Array:
    """Columns of any lengths as one compressed value: what Spark only carries along needn't be arrays of its own, an element at a time."""
    batch, sink = pa.RecordBatch.from_arrays([_lists(x, np.array([len(x)])) for x in columns.values()], names=[*columns]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def _unpacked(value: pa.Scalar) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(value.as_buffer()).read_next_batch()
    return {name: batch.column(name)[0].values for name in batch.schema.names}


def _cuttable(names: list[str]) -> np.ndarray:
    """Whether both vocabularies surely end a token between two bytes of ASCII that aren't both white. names: the pieces of B.

    A splits text by a pattern before it merges: runs of letters, of digits and of other marks, each with a space before it, "'s" and the
    like, and white space, of which a run's last character stands alone before what isn't white."""
    kind = np.full(256, -1)
    for c in range(33, 127):
        kind[c] = 0 if chr(c).isalpha() else 1 if chr(c).isdigit() else 2
    kind[[9, 10, 11, 12, 13, 32]] = 3
    cut = (kind[:, None] != kind[None, :]) & (kind[:, None] >= 0) & (kind[None, :] >= 0)
    cut[ord("'"), :] &= kind == 3
    cut[32, :] = False
    for name in names:
        data = name.replace("\u2581", " ").encode()
        for x, y in zip(data, data[1:], strict=False):
            cut[x, y] = False
    return cut


class Units:
    """Both vocabularies' tokens of units of text.

    A unit whose tokens' bytes are not its own has none: ok is false, and a token of either side stands for what there is."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, a_bytes = encoder(a_path, plain=True), Decoder(a_path, plain=True).table.to_pylist()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^\u2581]\u2581", name) for name in names):
            raise ValueError("a piece of this vocabulary reaches over a space")
        b_bytes = [bytes.fromhex(m[1]) if (m := _BYTE.fullmatch(x)) else x.replace("\u2581", " ").encode() for x in names]
        self.tables = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        #: The library gives no id for an empty text, which is what follows the space of a unit of one space.
        self.space = [self.b.piece_to_id("\u2581")]
        self.cuttable = _cuttable(names)
        # the library puts a space before what it encodes: before units without one there is a character that merges with none
        if [self.b.id_to_piece(i) for i in self.b.encode("\x01")] != ["\u2581", "<0x01>"] or any("\x01" in name for name in names):
            self.cuttable &= np.arange(256) == 32
        self.memo, self.hits = self._learn(pa.array([], pa.string())), np.empty(0, np.int64)

    def _pieces(self, units: list[str]) -> list[list[int]]:
        found = self.b.encode([u[1:] if u[0] == " " else "\x01" + u for u in units], num_threads=1)
        return [ids[2:] if u[0] != " " else ids if len(u) > 1 else self.space for u, ids in zip(units, found, strict=True)]

    def _learn(self, units: pa.Array) -> pa.RecordBatch:
        """unit, ok, a, b, and the ends of tokens: as bytes (those of a, 0, those of b) in shape for short units, else as lists."""
        data, offsets = utf8(units)
        found = self._pieces(units.to_pylist())
        b = np.array([i for ids in found for i in ids], "<u4"), _starts(np.array([len(ids) for ids in found], np.int64))
        sides, ok = [], np.ones(len(units), bool)
        for (ids, at), table in zip((self.a.column(units), b), self.tables, strict=True):
            bytes_, ends = _taken(table, ids)
            starts = ends[at]
            if len(bytes_) != len(data) or (starts != offsets).any() or (bytes_ != data).any():
                whole, own = memoryview(bytes_), memoryview(data)
                ok &= [whole[x:y] == own[v:w] for x, y, v, w in zip(starts[:-1].tolist(), starts[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sides.append((ids.astype(np.int32), (ends[1:] - np.repeat(starts[:-1], np.diff(at))).astype(np.int32), np.diff(at)))
        if len(self.a.units) > MEMO // 4:  # what this class remembers needn't be remembered twice
            self.a.units.clear()
        if not ok.all():
            for k, (ids, ends, sizes) in enumerate(sides):
                keep, size = np.repeat(ok, sizes), np.where(ok, sizes, 1)
                own = np.repeat(ok, size)
                new = np.zeros(len(own), np.int32), np.ones(len(own), np.int32)
                new[0][own], new[1][own] = ids[keep], ends[keep]
                sides[k] = (*new, size)
        (a, a_ends, n_a), (b, b_ends, n_b) = sides
        short = (n_a * n_b <= SHORT) & (np.where(ok, np.diff(offsets), 1) < 256)
        at = _starts(np.where(short, n_a + n_b + 1, 0))
        shape = np.zeros(int(at[-1]), np.uint8)
        first = at[:-1][short]
        shape[_spans(first, n_a[short])] = a_ends[np.repeat(short, n_a)]
        shape[_spans(first + n_a[short] + 1, n_b[short])] = b_ends[np.repeat(short, n_b)]
        ends = [_lists(x[np.repeat(~short, n)], np.where(short, 0, n)) for x, n in ((a_ends, n_a), (b_ends, n_b))]
        return pa.RecordBatch.from_arrays([units, pa.array(ok), _lists(a, n_a), _lists(b, n_b), _binary(shape, at), *ends], names=["unit", "ok", "a", "b", "shape", "a_ends", "b_ends"])

    def of(self, units: pa.Array) -> pa.RecordBatch:
        """What _learn gives, of distinct units."""
        place = pc.index_in(units, value_set=self.memo.column("unit"))
        new = np.asarray(pc.is_null(place))
        known = np.asarray(place.drop_null()).astype(np.int64)
        learned = self._learn(units.filter(pa.array(new)))
        order = np.empty(len(units), np.int64)
        order[~new], order[new] = np.arange(len(known)), len(known) + np.arange(learned.num_rows)
        out = _joined([self.memo.take(pa.array(known)), learned]).take(pa.array(order))
        self.hits[known] += 1
        kept = learned.filter(pa.array((np.asarray(pc.binary_length(learned.column("shape"))) > 0) & (np.asarray(pc.binary_length(learned.column("unit"))) < 64)))
        self.memo, self.hits = _joined([self.memo, kept]), np.r_[self.hits, np.ones(kept.num_rows, np.int64)]
        if len(self.hits) > MEMO:
            stay = np.sort(np.argsort(-self.hits, kind="stable")[: MEMO // 2])
            self.memo, self.hits = self.memo.take(pa.array(stay)), self.hits[stay] // 2
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of texts that begin with a space, and n + 1 offsets among them."""
        data, offsets = utf8(texts)
        n = len(data)
        mark = np.zeros(n + 1, bool)
        mark[1:n] = self.cuttable.ravel()[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        white = (data == 32) | ((data >= 9) & (data <= 13))
        # behind a white character only if it stands alone: what is before it is printable
        behind = np.flatnonzero(mark[1:n] & white[:-1]) + 1
        before = data[np.maximum(behind - 2, 0)]
        mark[behind[(behind < 2) | (before <= 32) | (before >= 127)]] = False
        # before a space that follows other letters, unless they are white
        space = np.flatnonzero((data[1:] == 32) & (data[:-1] >= 128)) + 1
        x, y, z = (data[np.maximum(space - k, 0)].astype(np.int64) for k in (1, 2, 3))
        code = (z << 16) | (y << 8) | x
        odd = (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (code == 0xE19A80) | (code == 0xE38080) | (code == 0xE2819F) | (code >= 0xE28080) & (code <= 0xE2808A) | np.isin(code, [0xE280A8, 0xE280A9, 0xE280AF])
        mark[space[~odd]] = True
        mark[offsets] = True
        at = np.flatnonzero(mark)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)), np.searchsorted(at, offsets)


_units: dict[tuple[str, str], Units] = {}


def tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for a few MB of text: the number of the shape of each distinct unit (-1 - k for the unit of number k in long), and packed in rest
    its documents (doc_id, n_a, n_b, the size of each and the numbers of its units, none where the bytes differ) and the short units' ids (a and b)."""

    def each(batches):
        known = _units.get((a_path, b_path)) or _units.setdefault((a_path, b_path), Units(a_path, b_path))
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                text = pc.fill_null(part.column("text"), "")
                units, at = known.cut(pc.binary_join_element_wise(" ", text, ""))
                coded = units.dictionary_encode()
                found, index = known.of(coded.dictionary), np.asarray(coded.indices).astype(np.int32)
                wrong = _starts(~np.asarray(found.column("ok"))[index])
                keep = (wrong[at[1:]] == wrong[at[:-1]]) & np.asarray(pc.greater(pc.binary_length(text), 0))
                size = np.where(keep, np.diff(at), 0)
                n_a, n_b = (_starts(np.asarray(pc.list_value_length(found.column(k)))[index]) for k in ("a", "b"))
                shaped = np.asarray(pc.binary_length(found.column("shape"))) > 0
                short, long = found.filter(pa.array(shaped)), found.filter(pa.array(~shaped))
                coded = short.column("shape").dictionary_encode()
                shape = np.empty(len(shaped), np.int32)
                shape[shaped], shape[~shaped] = np.asarray(coded.indices), -1 - np.arange(long.num_rows)
                data, place = utf8(coded.dictionary.cast(pa.large_binary()))
                zero = np.flatnonzero(data == 0)
                ends = data.astype(np.int32)
                a, b = zero - place[:-1], place[1:] - zero - 1
                shapes = pa.StructArray.from_arrays([_lists(ends[_spans(place[:-1], a)], a), _lists(ends[_spans(zero + 1, b)], b)], names=["a_ends", "b_ends"])
                fields = ["a", "a_ends", "b", "b_ends"]
                rest = {"doc_id": part.column("doc_id"), "size": size.astype(np.int32), "units": index[np.repeat(keep, np.diff(at))]}
                rest |= {k: np.where(keep, n[at[1:]] - n[at[:-1]], 0) for k, n in (("n_a", n_a), ("n_b", n_b))} | {k: short.column(k).flatten() for k in ("a", "b")}
                columns = {"shape": shape, "shapes": shapes, "long": pa.StructArray.from_arrays([long.column(k) for k in fields], names=fields)}
                yield pa.RecordBatch.from_arrays([*(_lists(x, np.array([len(x)])) for x in columns.values()), _packed(rest)], names=[*_TOKENS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, _schema(_TOKENS))


def _last_tokens(ends: Column, shared: Column) -> Column:
    """Numbers of the tokens that end where shared says so: an entry for each byte of the unit."""
    return F.filter(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: shared[ends[i] - 1])


def _last_of_groups(unit: Column) -> Column:
    """(a, b): the numbers of each group's last token of either vocabulary, which are those that end where both do."""

    def shared(ends: Column) -> Column:
        before = lambda i: F.when(i > 0, ends[i - 1]).otherwise(0)
        return F.flatten(F.transform(ends, lambda e, i: F.concat(F.array_repeat(F.lit(False), e - before(i) - 1), F.array(F.lit(True)))))

    def last(at: Column) -> Column:
        return F.struct(_last_tokens(unit["a_ends"], at).alias("a"), _last_tokens(unit["b_ends"], at).alias("b"))

    return let(let(F.array_intersect(unit["a_ends"], unit["b_ends"]), shared), last)


def _groups(unit: Column) -> Column:
    """(a0, a, b0, b) of each group: the numbers of the first and last token of either vocabulary between two shared ends."""

    def groups(x: Column) -> Column:
        first = lambda k, g: F.when(g > 0, x[k][g - 1] + 1).otherwise(0)
        return F.transform(x["a"], lambda a, g: F.struct(first("a", g).alias("a0"), a.alias("a"), first("b", g).alias("b0"), x["b"][g].alias("b")))

    return let(_last_of_groups(unit), groups)


def _run(unit: Column, group: Column, side: str) -> Column:
    first = group[side + "0"]
    return F.slice(unit[side], first + 1, group[side] - first + 1)


def _pairs(run: Column) -> Column:
    """All distinct pairs (a, b, times) of a group, of which run holds the ids as arrays a and b."""
    pair = lambda x, y, times: F.struct(x.alias("a"), y.alias("b"), times.alias("times"))
    distinct = lambda ids: F.when(F.size(ids) == 1, ids).otherwise(F.array_distinct(ids))
    count = lambda ids, x: F.when(F.size(ids) == 1, F.lit(1)).otherwise(F.size(F.filter(ids, lambda y: y == x)))
    times = lambda x, y: count(run["a"], x).cast("long") * count(run["b"], y)
    several = F.flatten(F.transform(distinct(run["a"]), lambda x: let(distinct(run["b"]), lambda b: F.transform(b, lambda y: pair(x, y, times(x, y))))))
    alone = F.array(pair(run["a"][0], run["b"][0], F.lit(1).cast("long")))
    return F.when((F.size(run["a"]) == 1) & (F.size(run["b"]) == 1), alone).otherwise(several)


def _aligned_unit(unit: Column) -> Column:
    """text (`a1,a2|b1;a3|b2,b3`), groups and links (how many), and a, b, times: the distinct pairs of each group, side by side."""
    ids = lambda x: F.array_join(x.cast("array<string>"), ",")
    text = lambda run: F.concat(ids(run["a"]), F.lit("|"), ids(run["b"]))
    links = lambda run: F.size(run["a"]).cast("long") * F.size(run["b"])

    def filled(text_: Column, groups: Column, links_: Column, pairs: Column) -> Column:
        return let(pairs, lambda p: F.struct(text_.alias("text"), groups.cast("long").alias("groups"), links_.alias("links"), *[p[k].alias(k) for k in ("a", "b", "times")]))

    def parts(groups: Column) -> Column:
        runs = F.transform(groups, lambda g: F.struct(_run(unit, g, "a").alias("a"), _run(unit, g, "b").alias("b")))
        total = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda n, run: n + links(run))
        return let(runs, lambda r: filled(F.array_join(F.transform(r, text), ";"), F.size(r), total(r), F.flatten(F.transform(r, _pairs))))

    # where one side is one token there is one group, and where both end at the same places each token is one
    whole = filled(text(unit), F.lit(1), links(unit), _pairs(unit))
    n = F.size(unit["a"])
    joined = F.array_join(F.zip_with(unit["a"], unit["b"], lambda a, b: F.concat(a.cast("string"), F.lit("|"), b.cast("string"))), ";")
    alike = F.struct(joined.alias("text"), n.cast("long").alias("groups"), n.cast("long").alias("links"), unit["a"].alias("a"), unit["b"].alias("b"), F.array_repeat(F.lit(1).cast("long"), n).alias("times"))
    return F.when(n == 0, None).when(unit["a_ends"] == unit["b_ends"], alike).when((n == 1) | (F.size(unit["b"]) == 1), whole).otherwise(let(_groups(unit), parts))


_numbers: dict[int, pa.Array] = {}


def _text(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, first: np.ndarray) -> pa.Array:
    """Text of units, `a1,a2|b1;a3|b2,b3;`. a, b: their tokens, in groups of p and q; first: n + 1 offsets of units among the groups."""
    n = 1 << max(int(x.max(initial=0)) for x in (a, b)).bit_length()
    if n not in _numbers:  # each id with what may follow it
        _numbers[n] = pa.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], pa.large_string()).cast(pa.large_binary())
    p_at, q_at = _starts(p), _starts(q)
    ids = np.empty(len(a) + len(b), np.int64)
    in_a, in_b = np.arange(len(a)) + np.repeat(q_at[:-1], p), np.arange(len(b)) + np.repeat(p_at[1:], q)
    ids[in_a], ids[in_b] = a, b
    ids[in_a[p_at[1:] - 1]] += n
    ids[in_b[q_at[1:] - 1]] += 2 * n
    data, at = _taken(_numbers[n], ids)
    return _binary(data, at[(p_at + q_at)[first]])


def _documents(row: dict[str, pa.Array]) -> pa.RecordBatch:
    """The documents of a row of tokens() whose shapes and long units are aligned."""
    a, b, shape, units, size = (np.asarray(row[k]) for k in ("a", "b", "shape", "units", "size"))
    (a_last, at), (b_last, _) = (_flat(row["shapes"].field(k)) for k in ("a", "b"))
    long = row["long"]
    # groups of the short units, of p and q tokens
    kinds = shape[shape >= 0]
    groups = np.diff(at)[kinds]
    group, first = _spans(at[kinds], groups), _starts(groups)
    head = np.zeros(len(group), bool)
    head[first[:-1]] = True
    p, q = (x[group].astype(np.int64) - np.where(head, -1, x[group - 1]) for x in (a_last, b_last))
    # a group's pairs of tokens, each as one number
    n = p * q
    k, across = np.arange(int(n.sum())) - np.repeat(_starts(n)[:-1], n), np.repeat(q, n)
    of_a, of_b = (np.repeat(_starts(x)[:-1], n) + i for x, i in ((p, k // across), (q, k % across)))
    pair, links = (a[of_a].astype(np.int64) << ID_BITS) | b[of_b], np.diff(_starts(n)[first])
    text = _text(a, b, p, q, first)
    # the long ones' behind them
    long_a, long_at = _flat(long.field("a"))
    pair = np.r_[pair, (long_a.astype(np.int64) << ID_BITS) | np.asarray(long.field("b").flatten())]
    more = np.r_[np.zeros(len(k), np.int64), np.asarray(long.field("times").flatten()) - 1]
    text = pa.concat_arrays([text, pc.binary_join_element_wise(long.field("text"), "", ";").cast(pa.binary()).cast(pa.large_binary())])
    n_groups, n_links, n_pairs = (np.r_[x, y].astype(np.int64) for x, y in ((groups, long.field("groups")), (links, long.field("links")), (links, np.diff(long_at))))
    place = np.empty(len(shape), np.int64)
    place[shape >= 0], place[shape < 0] = np.arange(len(kinds)), len(kinds) - 1 - shape[shape < 0]
    # from here on units as they occur
    units, at = place[units], _starts(size)
    total = lambda x: np.diff(_starts(x[units])[at])
    data, ends = _taken(text, units)
    written = pc.binary_slice(_binary(data, ends[at]).cast(pa.binary()), 0, -1).cast(pa.string())
    held = _spans(_starts(n_pairs)[units], n_pairs[units])
    key = (np.repeat(np.arange(len(size)), total(n_pairs)) << 2 * ID_BITS) | pair[held]
    several = np.flatnonzero(more[held])
    several = key[several], more[held[several]]
    key.sort()
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    times, key = np.diff(np.r_[start, len(key)]), key[start]
    np.add.at(times, np.searchsorted(key, several[0]), several[1])
    each = np.bincount(key >> 2 * ID_BITS, minlength=len(size))
    sides = (((key >> shift) & ((1 << ID_BITS) - 1)).astype(np.int32) for shift in (ID_BITS, 0))
    columns = [*(row[k] for k in ("doc_id", "n_a", "n_b")), pa.array(total(n_groups)), pa.array(total(n_links)), written, *(_lists(x, each) for x in (*sides, times))]
    return pa.RecordBatch.from_arrays(columns, names=[*_DOCUMENTS])


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (a string: `a1,a2|b1;a3|b2,b3`), and its distinct pairs with
    the number of links as arrays side by side: a, b, times. The tokens are written once, to the shared folder."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield _documents({k: batch.column(k)[i].values for k in ("shape", "shapes", "long")} | _unpacked(batch.column("rest")[i]))

    found, path = tokens(docs, a_path, b_path, id_col, text_col), new_folder(docs.sparkSession, "tokens")
    # rows of some MB: without these, a file's rows would be held together when written and read
    found.write.option("parquet.block.size", SLICE_BYTES).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(path)
    rows = docs.sparkSession.read.schema(found.schema).parquet(path)
    done = rows.withColumns({"shapes": F.transform("shapes", _last_of_groups), "long": F.transform("long", _aligned_unit)})
    return done.mapInArrow(each, _schema(_DOCUMENTS))


def _key(a: Column, b: Column) -> Column:
    """Both ids as one long: what has a hash of its own in arrays and joins."""
    return F.shiftleft(a.cast("long"), 32) + b


def pair_counts(documents: DataFrame) -> DataFrame:
    """documents: rows with distinct pairs as a and b. pair (a * 2^32 + b), documents (that hold it linked), best (whether no other pair of its a has more)."""
    each = documents.select("b", F.posexplode("a").alias("i", "x")).select(_key(F.col("x"), F.col("b")[F.col("i")]).alias("pair"))
    counts = each.groupBy("pair").agg(F.count("*").alias("documents"))
    # a window's group is one id of A: no more rows than B has ids
    return counts.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy(F.shiftright("pair", 32))))


def link_scores(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair is the best of its A id), count_sum (of documents over links)."""
    found = aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    held = materialise(found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"), "links")
    counts = materialise(pair_counts(held), "pairs")
    links = held.select("row", "b", "times", F.posexplode("a").alias("i", "x")).select("row", _key(F.col("x"), F.col("b")[F.col("i")]).alias("pair"), F.col("times")[F.col("i")].alias("times"))
    if counts.count() <= broadcast_pairs:
        joined = links.join(F.broadcast(counts), "pair")
    else:
        salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = links.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    return held.drop("a", "b", "times").join(sums, "row", "left").drop("row").na.fill(0, ["n_best", "count_sum"])
