"""Removal of byte passages that an earlier document holds, by suffix arrays of shared contexts.

A byte goes if a string of 50 bytes covers it that also starts in a document of smaller id. Each 50-byte window has an anchor: the 24-byte gram of
smallest hash in it. Equal windows have equal anchors, so only anchors that several documents hold matter; the anchor and the
windows that chose it are its context, 50 to 76 bytes.

1. Tasks hash anchors and contexts, keep one entry per context and batch with its smallest document, and send packed entries to
   the part of their anchor. There, a context that a smaller document holds too is covered as a whole; an anchor with several
   contexts needs a closer look at the first document of each.
2. Those documents send the bytes of these contexts to the part of the anchor. Windows whose hash no other document has there are left
   out; a suffix array over all contexts of the part sorts the rest (suffix_groups). Windows with 50 equal bytes are neighbours in it;
   each group's smallest document decides.
3. Covered windows return to their documents, whose bytes are cut in one pass.

Texts are shuffled twice, entries once; only contexts that differ are sorted. All packed columns are arrays of fixed-width numbers. An anchor with
more than HOT_CONTEXTS contexts sends windows apart, each under its own key, so that no part holds an unbounded group.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored, text_or_empty, unused
from panelwright.llm.suffix_groups import suffix_array

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # grams per window
SLICE_BYTES = 200_000
BATCH_ENTRIES = 1_000_000
PART_BYTES = 24_000_000
HOT_CONTEXTS = 20_000
SORT_SYMBOLS = 200_000

COVERED, CLOSER, HOT = 0, 1, 2


# --- anchors ----------------------------------------------------------------------------------

def _numpy():
    import numpy as np

    return np


def _tables():
    np = _numpy()
    return np.random.default_rng(20).integers(1, 2**64, 300, dtype=np.uint64)


def mix(x):
    np = _numpy()
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _blocks(data):
    """Hashes of all strings of 24 and, unmixed, of 50 bytes of a buffer: sums of random numbers of the bytes, times odd random numbers of the
    places, built up from those of 1, 2, 4 ... bytes."""
    np = _numpy()
    table = _tables()
    odd = table[256:] | np.uint64(1)
    size, have, level = 1, table[data], 0
    kept = {}
    while size < 32:
        have = have[:-size] * odd[level] + have[size:] if len(have) > size else have[:0]
        size, level = size * 2, level + 1
        kept[size] = have

    def joined(a, width, times):
        n = max(0, len(data) - width + 1)
        return kept[a][:n] * times + kept[a][width - a : width - a + n]

    return mix(joined(16, GRAM, odd[10])), joined(32, LENGTH, odd[11])


def _sliding(f, a, width):
    done, out = 1, a
    while done * 2 <= width:
        out = f(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = f(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors(data, sizes):
    """For texts laid end to end: (text, position, first window, last window, anchor hash, context hash) of each anchor, by position.

    A window takes the rightmost of its smallest grams, so equal windows take the same. Neighbouring windows with the same choice make one context.
    """
    np = _numpy()
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    with np.errstate(over="ignore"):
        grams, wholes = _blocks(data)
    # Half of the hash and the place from the right in one number: the smallest is the window's choice.
    high, places = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
    choice = _sliding(np.minimum, (grams & high) | (places - np.arange(len(grams), dtype=np.uint64)), SPAN)
    text = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero(text[: len(choice)] == text[LENGTH - 1 :])
    if not len(start):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    at = (places - (choice[start] & places)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first, last = start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
    where, anchor = at[new], grams[at[new]]
    with np.errstate(over="ignore"):
        context = mix(mix(wholes[first]) * np.uint64(0xE7037ED1A0B428DB) + mix(wholes[last] + ((last - first) * 64 + (where - first)).astype(np.uint64)))
    return text[first], where, first, last, anchor & np.uint64((1 << 63) - 1), context & np.uint64(LOW48)


def _slices(texts):
    """(numbers of the texts, their bytes end to end, their sizes) of some texts at a time."""
    np = _numpy()
    chosen, raw, size = [], [], 0
    for i, text in enumerate(texts):
        b = text.as_py().encode("utf-8", "surrogatepass")
        chosen.append(i)
        raw.append(b)
        size += len(b)
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield np.array(chosen), b"".join(raw), np.array([len(b) for b in raw], dtype=np.int64)
            chosen, raw, size = [], [], 0


def _key(anchor, context):
    """One number for a context, from 48 bits of its anchor and of itself."""
    np = _numpy()
    with np.errstate(over="ignore"):
        return mix((anchor & np.uint64(LOW48)) * np.uint64(0x8BB84B93962EACC9) + context)


LOW48 = (1 << 48) - 1


# --- 1: entries -------------------------------------------------------------------------------

ENTRY_SCHEMA = "part int, docs binary, hashes binary, owners binary"
DONE_SCHEMA = "_id bigint, tag bigint, kind int, keys binary"
DONE_ARROW = pa.schema([("_id", pa.int64()), ("tag", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary())])


def _part_of(anchor, parts: int):
    np = _numpy()
    return ((anchor >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def _pack48(x):
    np = _numpy()
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(raw: bytes):
    np = _numpy()
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _entries(parts: int):
    """Packed (anchor, context, document) entries by part, one per context, batch and text of its smallest id; part -1 holds what the batch
    itself shows: contexts of documents that are not its smallest."""

    def flush(held, seen):
        np = _numpy()
        doc, anchor, context = (np.concatenate(x) for x in zip(*held))
        all_ids, all_tags = (np.concatenate(x) for x in zip(*seen))
        ids = all_ids[doc]
        # Equal contexts have equal keys; only those that occur again are put in the order of their documents.
        key = _key(anchor, context)
        order = np.argsort(key)
        again = key[order][1:] == key[order][:-1]
        again = np.flatnonzero(np.r_[False, again] | np.r_[again, False])
        own = order[again]
        order[again] = own[np.lexsort((doc[own], ids[own], context[own], anchor[own], key[own]))]
        doc, ids, anchor, context = doc[order], ids[order], anchor[order], context[order]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        over = ids > least
        rows = _by_document(ids[over], all_tags[doc[over]], np.zeros(over.sum(), dtype=np.int64), _key(anchor[over], context[over]))
        out = [(-1, *_document(i, t), k, b"") for i, t, _, k in rows]
        # Other texts of the smallest id are sent on too: a smaller id may be in another batch.
        sent = ~over & (new | np.r_[True, doc[1:] != doc[:-1]])
        doc, anchor, context = doc[sent], anchor[sent], context[sent]
        part = _part_of(anchor, parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            own = order[bounds[p] : bounds[p + 1]]
            if len(own):
                numbers, owner = np.unique(doc[own], return_inverse=True)
                docs = np.stack([all_ids[numbers], all_tags[numbers]], axis=1)
                hashes = _pack48(anchor[own] & np.uint64(LOW48)) + _pack48(context[own] & np.uint64(LOW48))
                out.append((p, docs.astype("<i8").tobytes(), hashes, owner.astype("<u4" if len(docs) > 65535 else "<u2").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "docs", "hashes", "owners"])

    def run(batches):
        np = _numpy()
        held, seen, size, documents = [], [], 0, 0
        for batch in batches:
            ids, tags = batch.column("_id").to_numpy(), batch.column("tag").to_numpy()
            for chosen, raw, sizes in _slices(batch.column("_text")):
                text, _, _, _, anchor, context = anchors(np.frombuffer(raw, dtype=np.uint8), sizes)
                held.append((documents + text, anchor, context))
                seen.append((ids[chosen], tags[chosen]))
                size, documents = size + len(text), documents + len(chosen)
                if size > BATCH_ENTRIES:
                    yield flush(held, seen)
                    held, seen, size, documents = [], [], 0, 0
        if size:
            yield flush(held, seen)

    return run


def _document(i, t):
    np = _numpy()
    return (np.array([i, t], dtype="<i8").tobytes(),)


def _by_document(ids, tags, kinds, keys):
    """(id, tag, kind, packed keys) for each document and kind."""
    np = _numpy()
    if not len(ids):
        return
    order = np.lexsort((keys, kinds, tags, ids))
    ids, tags, kinds, keys = ids[order], tags[order], kinds[order], keys[order]
    cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (kinds[1:] != kinds[:-1])])
    for a, b in zip(cut, [*cut[1:], len(ids)]):
        yield int(ids[a]), int(tags[a]), int(kinds[a]), keys[a:b].astype("<u8").tobytes()


def _decide(table: pa.Table) -> pa.Table:
    """All entries of a part: what is covered, and what needs a closer look. Keys are made of 48 bits of the anchor and of the context."""
    np = _numpy()
    out = []
    ids, tags, anchor, context = [], [], [], []
    for docs, hashes, owners in zip(table.column("docs").to_pylist(), table.column("hashes").to_pylist(), table.column("owners").to_pylist()):
        docs = np.frombuffer(docs, dtype="<i8").reshape(-1, 2)
        owner = np.frombuffer(owners, dtype="<u4" if len(docs) > 65535 else "<u2")
        half = len(hashes) // 2
        ids.append(docs[owner, 0])
        tags.append(docs[owner, 1])
        anchor.append(_unpack48(hashes[:half]))
        context.append(_unpack48(hashes[half:]))
    ids, tags, anchor, context = (np.concatenate(x) for x in (ids, tags, anchor, context))
    # Most anchors are alone: drop them before sorting by all columns.
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    keep = order[np.r_[False, same] | np.r_[same, False]] if len(order) > 1 else order[:0]
    ids, tags, anchor, context = ids[keep], tags[keep], anchor[keep], context[keep]
    order = np.lexsort((ids, context, anchor))
    ids, tags, anchor, context = ids[order], tags[order], anchor[order], context[order]
    if len(ids):
        head = np.r_[True, anchor[1:] != anchor[:-1]]
        new = head | np.r_[True, context[1:] != context[:-1]]
        first = np.flatnonzero(new)
        least = ids[first][np.cumsum(new) - 1]
        # Every row of the smallest id counts as first: rows of one id differ in text, if they occur.
        is_first = ids == least
        bucket = np.cumsum(head) - 1
        contexts = np.bincount(bucket[first])
        low = np.minimum.reduceat(ids, np.flatnonzero(head))
        high = np.maximum.reduceat(np.where(new, ids, low[bucket]), np.flatnonzero(head))
        closer = is_first & (contexts[bucket] > 1) & (low[bucket] < high[bucket])
        kinds = np.where(is_first, np.where(contexts[bucket] > HOT_CONTEXTS, HOT, CLOSER), COVERED)
        chosen = ~is_first | closer
        out = list(_by_document(ids[chosen], tags[chosen], kinds[chosen], _key(anchor[chosen], context[chosen])))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, DONE_ARROW)], schema=DONE_ARROW)


def _decided(table: pa.Table) -> pa.Table:
    own = table.column("part")[0].as_py() >= 0
    if own:
        return _decide(table.drop_columns(["part", "spread"]))
    np = _numpy()
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), dtype="<i8").reshape(-1, 2)
    columns = [pa.array(docs[:, 0]), pa.array(docs[:, 1]), pa.array(np.zeros(len(docs), dtype=np.int32)), table.column("hashes").combine_chunks()]
    return pa.Table.from_arrays(columns, schema=DONE_ARROW)


# --- 2: contexts ------------------------------------------------------------------------------

CONTEXT_SCHEMA = "part int, docs binary, numbers binary, bytes binary"


def _chosen_keys(lists, kinds=None):
    """Sorted keys of one document's lists; lists: [(kind, packed)]."""
    np = _numpy()
    parts = [np.frombuffer(x["keys"], dtype="<u8") for x in lists if kinds is None or x["kind"] in kinds]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def _is_in(x, ordered):
    np = _numpy()
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _of_documents(texts):
    """(number of the text, its bytes, and of its anchors: place, first window, last window, anchor, key), several texts hashed at a time."""
    np = _numpy()
    for chosen, raw, sizes in _slices(texts):
        text, where, first, last, anchor, context = anchors(np.frombuffer(raw, dtype=np.uint8), sizes)
        key = _key(anchor, context)
        starts = np.cumsum(sizes) - sizes
        cut = np.searchsorted(text, np.arange(len(sizes) + 1))
        for n, (i, at, size) in enumerate(zip(chosen.tolist(), starts.tolist(), sizes.tolist())):
            own = slice(cut[n], cut[n + 1])
            yield i, raw[at : at + size], where[own] - at, first[own] - at, last[own] - at, anchor[own], key[own]


def _contexts(parts: int):
    """Bytes of contexts that need a closer look, packed by part: per context its anchor, first window, length, place of the anchor and document."""

    def run(batches):
        np = _numpy()
        held: dict[int, list] = {}
        size = 0

        def flush():
            rows = []
            for p, items in held.items():
                docs = sorted({(i, t) for i, t, _, _ in items})
                number = {d: k for k, d in enumerate(docs)}
                numbers = np.array([(*n, number[(i, t)]) for i, t, n, _ in items], dtype="<i8")
                rows.append((p, np.array(docs, dtype="<i8").tobytes(), numbers.tobytes(), b"".join(x[3] for x in items)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "docs", "numbers", "bytes"])

        for batch in batches:
            ids, tags, lists = batch.column("_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("lists").to_pylist()
            for i, raw, where, first, last, anchor, key in _of_documents(batch.column("_text")):
                closer, hot = _chosen_keys(lists[i], (CLOSER,)), _chosen_keys(lists[i], (HOT,))
                apart = _is_in(key, hot)
                own = np.flatnonzero(apart | _is_in(key, closer))
                rows = zip(_part_of(anchor[own], parts).tolist(), anchor[own].tolist(), first[own].tolist(), last[own].tolist(), where[own].tolist(), apart[own].tolist())
                for part, a, f, z, w, windows_apart in rows:
                    if not windows_apart:
                        held.setdefault(part, []).append((ids[i], tags[i], (a, f, z + LENGTH - f, w - f), raw[f : z + LENGTH]))
                        size += z + LENGTH - f
                        continue
                    for x in range(f, z + 1):
                        window = raw[x : x + LENGTH]
                        name = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little") >> 1
                        part = int(_part_of(np.array([name], dtype=np.uint64), parts)[0])
                        held.setdefault(part, []).append((ids[i], tags[i], (name, x, LENGTH, 0), window))
                        size += LENGTH
                if size > 8_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


SPANS_ARROW = pa.schema([("_id", pa.int64()), ("tag", pa.int64()), ("windows", pa.binary())])


def _sort_contexts(table: pa.Table) -> pa.Table:
    """Covered windows of the contexts of a part, as packed positions per document."""
    np = _numpy()
    docs, numbers, raw, seen, base = [], [], [], 0, 0
    for d, n, b in zip(table.column("docs").to_pylist(), table.column("numbers").to_pylist(), table.column("bytes").to_pylist()):
        d = np.frombuffer(d, dtype="<i8").reshape(-1, 2)
        n = np.frombuffer(n, dtype="<i8").reshape(-1, 5).copy()
        n[:, 4] += seen
        start = base + np.cumsum(n[:, 2]) - n[:, 2]
        numbers.append(np.column_stack([n, start]))
        docs.append(d)
        raw.append(b)
        seen += len(d)
        base += len(b)
    docs, numbers, data = np.concatenate(docs), np.concatenate(numbers), np.frombuffer(b"".join(raw), dtype=np.uint8)
    numbers = numbers[np.argsort(numbers[:, 0], kind="stable")]
    found_ids, found_tags, found = [], [], []
    for rows in _whole_anchors(numbers, SORT_SYMBOLS):
        rows = _shared(rows, data, docs[:, 0])
        if len(rows):
            doc, window = _covered_windows(rows, data, docs[:, 0])
            found_ids.append(docs[doc, 0])
            found_tags.append(docs[doc, 1])
            found.append(window)
    out = []
    if found:
        ids, tags, windows = (np.concatenate(x) for x in (found_ids, found_tags, found))
        out = [(i, t, k) for i, t, _, k in _by_document(ids, tags, np.zeros(len(ids), dtype=np.int64), windows.astype(np.uint64))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, SPANS_ARROW)], schema=SPANS_ARROW)


def _whole_anchors(numbers, size: int):
    """Rows of whole anchors, up to about `size` bytes of contexts at a time; windows of different anchors never match."""
    np = _numpy()
    upto = np.cumsum(numbers[:, 2])
    heads = np.r_[np.flatnonzero(np.r_[True, numbers[1:, 0] != numbers[:-1, 0]]), len(numbers)]
    at = 0
    while at < len(numbers):
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size)) + 1
        end = int(heads[min(np.searchsorted(heads, end), len(heads) - 1)])
        yield numbers[at:end]
        at = end


def _shared(rows, data, ids):
    """Contexts cut down to the windows that may be in two documents, by hash; contexts without any go.

    Equal windows have equal hashes, so nothing is lost; whether windows of equal hash are equal is for the suffix array to say.
    """
    np = _numpy()
    sizes, windows = rows[:, 2], rows[:, 2] - LENGTH + 1
    begin = np.cumsum(sizes) - sizes
    joined = data[np.repeat(rows[:, 5] - begin, sizes) + np.arange(sizes.sum())]
    each = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
    with np.errstate(over="ignore"):
        name = _key(rows[each, 0].astype(np.uint64), _blocks(joined)[1][begin[each] + offset])
    owner = ids[rows[each, 4]]
    order = np.argsort(name)
    head = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
    several = np.minimum.reduceat(owner[order], head) < np.maximum.reduceat(owner[order], head)
    kept = np.sort(order[np.repeat(several, np.diff(np.r_[head, len(order)]))])
    if not len(kept):
        return rows[:0]
    new = np.flatnonzero(np.r_[True, each[kept][1:] != each[kept][:-1]])
    low, high = offset[kept[new]], offset[kept[np.r_[new[1:], len(kept)] - 1]]
    cut = rows[each[kept[new]]].copy()
    cut[:, 1] += low
    cut[:, 2] = high - low + LENGTH
    cut[:, 3] -= np.minimum(low, cut[:, 3])
    cut[:, 5] += low
    return cut


def _covered_windows(rows, data, ids):
    """(document, window position) of windows that a smaller document among the contexts holds.

    The gram of an anchor is one symbol, the anchor's own, so that a window has SPAN symbols. Windows sent apart are named by their bytes; for them
    the first 24 bytes take that part.
    """
    np = _numpy()
    names = np.cumsum(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) + 256
    sizes = rows[:, 2] - GRAM + 2  # the gram is one symbol, and a 0 ends the context
    begin = 1 + np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(1, 1 + len(row)) - begin[row]
    source = rows[row, 5] + at + np.where(at > rows[row, 3], GRAM - 1, 0)
    own = data[np.minimum(source, len(data) - 1)].astype(np.int64) + 1
    own = np.where(at == rows[row, 3], names[row], np.where(at == sizes[row] - 1, 0, own))
    text = np.concatenate([np.zeros(1, dtype=np.int64), own])
    windows = rows[:, 2] - LENGTH + 1
    owner = np.full(len(text), -1, dtype=np.int64)
    place = np.zeros(len(text), dtype=np.int64)
    each = np.repeat(np.arange(len(rows)), windows)
    offset = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
    owner[begin[each] + offset] = each
    place[begin[each] + offset] = offset
    order = np.array(suffix_array(text.tolist()), dtype=np.int64)
    order = order[owner[order] >= 0]
    new = np.ones(len(order), dtype=bool)
    for a in range(0, len(order), 50_000):
        own = text[order[a : a + 50_001, None] + np.arange(SPAN)]
        new[a + 1 : a + len(own)] = (own[1:] != own[:-1]).any(axis=1)
    owners = owner[order]
    doc = rows[owners, 4]
    least = np.minimum.reduceat(ids[doc], np.flatnonzero(new))[np.cumsum(new) - 1]
    over = ids[doc] > least
    return doc[over], rows[owners[over], 1] + place[order[over]]


# --- 3: cuts ----------------------------------------------------------------------------------

def removed_spans(size: int, first, last, key, lists, windows) -> list[tuple[int, int]]:
    """Removed runs of a text of some bytes, from its anchors, its covered contexts and its covered windows."""
    np = _numpy()
    edge = np.zeros(size + 1, dtype=np.int64)
    keys = _chosen_keys(lists or [], (COVERED,))
    if len(keys):
        hit = _is_in(key, keys)
        np.add.at(edge, first[hit], 1)
        np.add.at(edge, last[hit] + LENGTH, -1)
    for packed in windows or []:
        p = np.frombuffer(packed, dtype="<u8").astype(np.int64)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + LENGTH, -1)
    inside = np.r_[False, np.cumsum(edge)[:-1] > 0, False]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def kept_bytes(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def kept_text(raw: bytes, spans) -> str:
    """Characters that are not wholly removed."""
    out, at = [], 0
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        if b < len(raw) and raw[b] & 0xC0 == 0x80:
            while b > a and raw[b] & 0xC0 == 0x80:
                b -= 1
        out.append(raw[at:a])
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _cut(with_text: bool, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            lists, windows = batch.column("lists").to_pylist(), batch.column("windows").to_pylist()
            rows = []
            for i, raw, _, first, last, _, key in _of_documents(batch.column("_text")):
                spans = removed_spans(len(raw), first, last, key, lists[i], windows[i]) if lists[i] or windows[i] else []
                if with_text:
                    rows.append((kept_text(raw, spans),))
                else:
                    rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * (1 if with_text else 4)
            kept = [n for n in batch.schema.names if n not in ("lists", "windows", "_text", "tag")]
            made = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[len(kept) :])]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *made], schema=schema)

    return run


def repeats(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (_id, tag, lists, windows): what is covered in each document that has something covered."""
    spark = documents.sparkSession
    texts = documents.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("tag"), text_or_empty(text_col).alias("_text")
    )
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    entries = texts.mapInArrow(_entries(parts), ENTRY_SCHEMA)
    # What a batch decided itself only passes through: any task may take it.
    entries = entries.withColumn("spread", F.when(F.col("part") >= 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("docs"), F.lit(parts)).cast("int")))
    decided = stored(entries.groupBy("part", "spread").applyInArrow(_decided, DONE_SCHEMA), "decided")

    def lists(kinds: str):
        return decided.where(kinds).groupBy("_id", "tag").agg(F.collect_list(F.struct("kind", "keys")).alias("lists"))

    closer = texts.join(lists(f"kind <> {COVERED}").hint("shuffle_merge"), ["_id", "tag"]).select("_id", "tag", "lists", "_text")
    contexts = closer.mapInArrow(_contexts(parts), CONTEXT_SCHEMA)
    windows = contexts.groupBy("part").applyInArrow(_sort_contexts, "_id bigint, tag bigint, windows binary")
    windows = stored(windows, "covered-windows")
    by_window = windows.groupBy("_id", "tag").agg(F.collect_list("windows").alias("windows"))
    return lists(f"kind = {COVERED}").join(by_window, ["_id", "tag"], "full")


def _joined(documents: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    found = repeats(documents, id_col, text_col).withColumnsRenamed({"_id": "_found_id", "tag": "_found_tag"})
    rows = documents.select(
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("tag"), text_or_empty(text_col).alias("_text")
    )
    joined = rows.join(found, (F.col("_id") == F.col("_found_id")) & (F.col("tag") == F.col("_found_tag")), "left")
    return joined.select(*[f"_keep_{i}" for i in range(len(keep))], "_text", "lists", "windows")


def find_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256. Ids are whole numbers.

    A null text is empty; a text of fewer than 50 bytes loses nothing. Rows of equal id do not take from each other, only from smaller ids. A row without
    an id keeps all its bytes and takes none. Other columns are not looked at. No documents, no rows.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    joined = _joined(documents, id_col, text_col, [id_col])
    made = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([joined.schema[0], *made])
    cut = joined.mapInArrow(_cut(False, to_arrow_schema(schema)), schema)
    return cut.withColumnRenamed("_keep_0", id_col)


def without_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their texts, with all their columns; characters that are removed in part stay.

    A null text stays null, a text that loses all becomes empty, repeated rows stay each. Rows of equal id, or without one, are treated as in find_repeats.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = documents.columns
    others = [c for c in columns if c != text_col]
    null = unused(documents, "_null")
    joined = _joined(documents.withColumn(null, F.col(text_col).isNull()), id_col, text_col, [*others, null])
    schema = T.StructType([*joined.schema[: len(others) + 1], T.StructField("_cut", T.StringType())])
    cut = joined.mapInArrow(_cut(True, to_arrow_schema(schema)), schema)
    text = F.when(~F.col(f"_keep_{len(others)}"), F.col("_cut")).alias(text_col)
    named = {c: F.col(f"_keep_{i}").alias(c) for i, c in enumerate(others)}
    return cut.select(*[text if c == text_col else named[c] for c in columns])
