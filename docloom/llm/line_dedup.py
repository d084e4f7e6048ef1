"""Line dedup by a segment-partition edit join.

Of two lines at `tau` or fewer edits, one of tau + 1 segments of the shorter stands unchanged in the longer, at a place that the
lengths narrow down. Each distinct line indexes its segments and probes those substrings; equal hashes of (length, segment
number, substring) give candidates, of which those stay whose character counts allow it (an edit changes no more than two of
them), and a banded bit-parallel edit distance verifies. Tasks send (key, line, counts) as three numbers in blobs by the key's
hash, not as rows.

Where more than `crowd` x `crowd` entries meet at one key, they aren't paired: what is left of each line without the segment
goes through the same join again under that key. `crowd` is the same on every level, and what is left shrinks by a third each time.
When a dozen characters are left, points take over: strings with a character or two deleted or blanked. Lines of a point are all
near its least one, so a point gives a chain of links, however many lines it has, and no pair of them is ever made.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, crowded_keys, cut, join_once, scratch

_hash = xxhash.xxh3_64_intdigest
_MASK = (1 << 63) - 1
_PAIRS_ROWS = 50_000
_SHIFTS = np.arange(0, 64, 4, dtype=np.uint64)
#: Up to so many characters go by points.
_POINT_CHARS = 12
#: What stands for a segment taken out on a level: lone surrogates, which no line has.
_MARK = 0xD800


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance of a and b is tau or less.

    After common ends are cut off, a band of 2 * tau + 1 rows moves down the diagonal; its vertical steps are the bits of two
    numbers, and a column takes a dozen operations on them.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b or max(len(a), len(b)) <= tau:
        return max(len(a), len(b)) <= tau
    n, width = len(a), 2 * tau + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for r, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << r
    up, down = full ^ ((1 << tau) - 1), 0  # steps +1 and -1 of the column before, in the rows of the present band
    row = score = min(n, tau)
    for col, c in enumerate(b, 1):
        shift = col - tau - 1
        same = places.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & full
        flat = ((((same & up) + up) ^ up) | same | down) & full
        right_up, right_down = (down | ~(flat | up)) & full, flat & up
        if row < n:
            row += 1
            score += not flat & top
        else:
            bit = 1 << (n - col + tau)
            score += bool(right_up & bit) - bool(right_down & bit)
        if score - (len(b) - col) - (n - row) > tau:
            return False
        up, down = (right_down | ~((flat >> 1) | right_up)) & full, (flat >> 1) & right_up
    return score <= tau


def _seed(prefix: int, length: int, segment: int) -> int:
    return (prefix * 0x9E3779B97F4A7C15 + length * 64 + segment) & 0xFFFFFFFFFFFFFFFF


def _codes(text: str) -> bytes:
    """Four bytes a character, so that parts are slices."""
    return text.encode("utf-32-le", "surrogatepass")


def _key(prefix: int, length: int, segment: int, part: str) -> int:
    return _hash(_codes(part), _seed(prefix, length, segment)) & _MASK


@functools.lru_cache(4096)
def _segments(length: int, tau: int) -> tuple[tuple[int, int], ...]:
    """(start, length) of tau + 1 segments of a line, lengths alike but for one, the longer ones last."""
    base, longer = divmod(length, tau + 1)
    out, at = [], 0
    for k in range(tau + 1):
        n = base + (k > tau - longer)
        out.append((at, n))
        at += n
    return tuple(out)


@functools.lru_cache(8192)
def _places(size: int, tau: int, as_probe: bool) -> tuple[tuple[int, int, int], ...]:
    """(start, length, seed) of each segment, or of each substring that may be a segment of a line that is no longer."""
    if not as_probe:
        return tuple((at, n, _seed(0, size, k)) for k, (at, n) in enumerate(_segments(size, tau)))
    out = []
    for length in range(max(0, size - tau), size + 1):
        extra = size - length
        for k, (at, n) in enumerate(_segments(length, tau)):
            lo, hi = max(0, at - k, at + extra - (tau - k)), min(size - n, at + k, at + extra + (tau - k))
            out += [(p, n, _seed(0, length, k)) for p in range(lo, hi + 1)]
    return tuple(out)


def keys_of(text: str, tau: int, prefix: int, as_probe: bool) -> list[int]:
    raw, more = _codes(text), _seed(prefix, 0, 0)
    return [_hash(raw[4 * at : 4 * (at + n)], more + seed & 0xFFFFFFFFFFFFFFFF) & _MASK for at, n, seed in _places(len(text), tau, as_probe)]


def index_keys(text: str, tau: int, prefix: int = 0) -> list[tuple[int, int, int]]:
    """(key, start, length) of each segment."""
    return [(key, at, n) for key, (at, n, _) in zip(keys_of(text, tau, prefix, False), _places(len(text), tau, False), strict=True)]


def probe_keys(text: str, tau: int, prefix: int = 0) -> list[tuple[int, int, int]]:
    """(key, start, length) of each substring that may be a segment of a line that is no longer."""
    return [(key, at, n) for key, (at, n, _) in zip(keys_of(text, tau, prefix, True), _places(len(text), tau, True), strict=True)]


def _lines(text: str | None) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines that have a word."""
    for k, line in enumerate((text or "").split("\n")):
        if line.strip(" \t\x0b\x0c\r"):
            yield k, line


def _node(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "big") & _MASK


def counts(lines: Sequence[str]) -> np.ndarray:
    """How often characters of 16 classes occur in each line, modulo 16, four bits each."""
    out, at = [np.empty(0, np.int64)], 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and (end == at or chars + len(lines[end]) <= 1 << 20):
            chars += len(lines[end])
            end += 1
        codes = np.frombuffer(_codes("".join(lines[at:end])), "<u4") & 15
        of = np.repeat(np.arange(end - at), [len(x) for x in lines[at:end]])
        found = np.bincount(of * 16 + codes, minlength=16 * (end - at)).reshape(-1, 16) & 15
        out.append((found.astype(np.uint64) << _SHIFTS).sum(1, dtype=np.uint64).view(np.int64))
        at = end
    return np.concatenate(out)


def _may_be_near(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    """Whether counts differ by 2 * tau or less, as those of lines at tau edits do."""
    total = np.zeros(len(a), np.int64)
    for shift in range(0, 64, 4):
        d = ((a >> shift) - (b >> shift)) & 15
        total += np.minimum(d, 16 - d)
    return total <= 2 * tau

def _key_before(text: str, tau: int, prefix: int, key: int, at: int, n: int, as_probe: int) -> int | None:
    """The key of the segment before the one with this key, which stands at `at`, where it would be at the same shift."""
    size = len(text)
    for length in range(max(0, size - tau), size + 1) if as_probe else (size,):
        segments = _segments(length, tau)
        for k, (start, chars) in enumerate(segments):
            if chars == n and abs(at - start) <= tau and _key(prefix, length, k, text[at : at + n]) == key:
                if not k:
                    return None
                start, chars = segments[k - 1]
                place = at - chars
                return _key(prefix, length, k - 1, text[place : place + chars]) if place >= 0 else None
    return None


def _joint(parts: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def _roled(keys: Sequence[int], role: int) -> np.ndarray:
    """Keys with the role as their lowest bit."""
    return np.array(keys, np.int64) << 1 & _MASK | role


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the highest bits, so that what is sorted by key is sorted by bucket."""
    return ((keys >> 39) * buckets) >> 24


def _blobs(keys: np.ndarray, lines: np.ndarray, sketches: np.ndarray, buckets: int, crowd: int, points: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """Rows (bucket, blob): entries of one bucket, three numbers each. The lowest bit of a key says index or probe.

    Buckets from `buckets` on hold entries of points, and those from 2 * `buckets` on entries of keys that are crowded for sure:
    of a key that is crowded in this batch, the bucket gets as many as show that and the others are dealt out.
    """
    order = np.argsort(keys)
    entries = np.stack((keys[order], lines[order], sketches[order]), 1)
    where, dealt = _bucket(entries[:, 0], buckets), False
    if len(entries):
        role = np.flatnonzero(np.append(True, entries[1:, 0] != entries[:-1, 0]))  # first entry of each key with its role
        sizes = np.diff(np.append(role, len(entries)))
        base = entries[role, 0] >> 1
        paired = np.append(base[1:] == base[:-1], False)
        full = paired & (sizes * np.append(sizes[1:], 0) > (crowd + 1) * (crowd + 1))
        full[1:] |= full[:-1]
        if full.any():
            place = np.arange(len(entries)) - np.repeat(role, sizes)
            over = np.repeat(full, sizes) & (place > crowd)
            dealt = True
            where[over] = 2 * buckets + (np.repeat(entries[role, 1], sizes)[over] + place[over] // 4096) % buckets
    more, ids = points
    if len(more):
        order = np.argsort(more, kind="stable")
        add = np.stack((more[order], ids[order], np.zeros(len(more), np.int64)), 1)
        entries, where = np.concatenate((entries, add)), np.concatenate((where, buckets + _bucket(add[:, 0], buckets)))
    if dealt:
        order = np.argsort(where, kind="stable")
        where, entries = where[order], entries[order]
    firsts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.empty(0, np.int64)
    ends = np.append(firsts[1:], len(where))
    return pa.RecordBatch.from_arrays([pa.array(where[firsts], pa.int64()), pa.array([entries[i:j].tobytes() for i, j in zip(firsts, ends, strict=True)], pa.binary())], names=["bucket", "blob"])


# --- points ---

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.cumprod(np.array([1] + [_BASE] * 255, np.uint64), dtype=np.uint64)
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_BLANK = np.uint64(0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def point_keys(text: str, prefix: int, edits: int, least: int = 0) -> np.ndarray:
    """Keys of a string's points under a prefix; the lowest bit is 1 for far ones.

    Strings that have a near point in common are `edits` or fewer apart, and so are one that has it near and one that has it
    far; of two strings that are, one has such a point of the other's. Marks are never blanked nor deleted. No string of fewer
    than `least` characters matters. With edits 0, only the points where strings of more edits look for this one.
    """
    codes = np.frombuffer(_codes(text), "<u4")
    n = len(codes)
    free = np.flatnonzero((codes < _MARK) | (codes > 0xDFFF))
    powers = _POWERS[:n]
    values = _mixed(codes.astype(np.uint64))
    terms = values * powers
    below = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    whole, blanked = below[-1:], _BLANK * powers[free] - terms[free]
    deleted = below[free] + (whole - below[free + 1]) * _INVERSE  # without that character
    i, j = np.triu_indices(len(free), 1)
    out: list[tuple[int, int, int, np.ndarray]] = [(0, n, 0, whole), (1, n, 0, whole + blanked)]  # (kind, length, far, hashes)
    if edits and n - 1 >= least:
        out.append((0, n - 1, 1, deleted))
    if edits == 2:
        out += [(2, n, 0, whole + blanked[i] + blanked[j]), (3, n - 1, 0, deleted)]
        if n - 1 >= least and len(free) > 1:
            a, b = np.concatenate((i, j)), np.concatenate((j, i))  # a deleted, b blanked
            place = np.where(free[b] < free[a], powers[free[b]], powers[free[b]] * _INVERSE)
            out.append((1, n - 1, 1, deleted[a] + (_BLANK - values[free[b]]) * place))
        if n - 2 >= least:
            out.append((0, n - 2, 1, below[free[i]] + (below[free[j]] - below[free[i] + 1]) * _INVERSE + (whole - below[free[j] + 1]) * _INVERSE * _INVERSE))
    keys = []
    for kind, length, far, hashes in out:
        seed = np.uint64((prefix * 0x9E3779B97F4A7C15 + (4 * length + kind) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        keys.append((_mixed(hashes ^ seed) >> np.uint64(2)).astype(np.int64) << 1 | far)
    return np.unique(np.concatenate(keys))


def _unique(rows: np.ndarray) -> np.ndarray:
    """Rows sorted by their first two columns, each pair of those once."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))] if len(rows) else rows


def _chained(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the lines of each point to its least near one: a forest, so fewer than there are lines."""
    entries = _unique(entries)
    base = entries[:, 0] >> 1
    firsts = np.flatnonzero(np.append(True, base[1:] != base[:-1])) if len(base) else np.empty(0, np.int64)
    least = np.repeat(entries[firsts, 1], np.diff(np.append(firsts, len(base)))) if len(base) else base
    near = np.repeat(entries[firsts, 0] & 1 == 0, np.diff(np.append(firsts, len(base)))) if len(base) else base.astype(bool)
    ok = near & (least != entries[:, 1])
    links = _unique(np.stack((np.minimum(least[ok], entries[ok, 1]), np.maximum(least[ok], entries[ok, 1])), 1))
    root: dict[int, int] = {}
    kept = np.zeros(len(links), bool)
    for k, (x, y) in enumerate(links.tolist()):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        while (up := root.get(y, y)) != y:
            root[y] = y = root.get(up, up)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept[k] = True
    return links[kept, 0], links[kept, 1]


# --- the join ---


def _join_schema() -> pa.Schema:
    return pa.schema([("crowded", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])


def _out(crowded: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    rows = _unique(np.stack((a, b), 1))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), crowded)), pa.array(rows[:, 0]), pa.array(rows[:, 1])], schema=_join_schema())


def _groups(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry, end, index entries, probe entries) of each key of sorted entries."""
    base = entries[:, 0] >> 1
    firsts = np.flatnonzero(np.append(True, base[1:] != base[:-1])) if len(base) else np.empty(0, np.int64)
    ends = np.append(firsts[1:], len(base)) if len(base) else firsts
    probes = np.cumsum(np.append(0, entries[:, 0] & 1))
    n_probe = probes[ends] - probes[firsts]
    return firsts, ends, ends - firsts - n_probe, n_probe


def _joined(entries: np.ndarray, tau: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """From sorted (key with role, line, counts): pairs (crowded false, a, b), and (crowded true, key with role, line) where too many meet."""
    firsts, ends, n_index, n_probe = _groups(entries)
    many = n_index * n_probe > crowd * crowd
    if many.any():
        inside = np.repeat(many, ends - firsts)
        yield _out(True, entries[inside, 0], entries[inside, 1])
    out_a, out_b, waiting = [], [], 0
    # A line always meets itself.
    for g in np.flatnonzero(~many & (n_index > 0) & (n_probe > 0) & (n_index * n_probe > 1)).tolist():
        i, j, k = firsts[g], ends[g], firsts[g] + n_index[g]
        index, probe = entries[i:k], entries[k:j]
        a, b = np.repeat(index[:, 1], len(probe)), np.tile(probe[:, 1], len(index))
        ok = (a != b) & _may_be_near(np.repeat(index[:, 2], len(probe)), np.tile(probe[:, 2], len(index)), tau)
        out_a.append(np.minimum(a[ok], b[ok]))
        out_b.append(np.maximum(a[ok], b[ok]))
        waiting += len(out_a[-1])
        if waiting >= _PAIRS_ROWS:
            yield _out(False, np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, waiting = [], [], 0
    if waiting:
        yield _out(False, np.concatenate(out_a), np.concatenate(out_b))


def _without_crowds(entries: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries of other keys, those of keys that are crowded already or have so many on one side that they may become it)."""
    firsts, ends, n_index, n_probe = _groups(entries)
    many = np.repeat((n_index * n_probe > crowd * crowd) | (n_index + n_probe > crowd * crowd), ends - firsts)
    return entries[~many], entries[many]


def _meet(blobs: DataFrame, parts: int, buckets: int, tau: int, crowd: int, most: int) -> DataFrame:
    """The equality join of all entries, bucket by bucket: a task holds one bucket, and beyond `most` entries gives up those of crowded keys."""

    def bucket_of(at: int, blobs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, size, hot = [], 0, np.empty(0, np.int64)
        for entries in blobs:
            if at >= 2 * buckets:
                yield _out(True, entries[:, 0], entries[:, 1])
                continue
            if len(hot):
                known = np.isin(entries[:, 0] >> 1, hot)
                if known.any():
                    yield _out(True, entries[known, 0], entries[known, 1])
                    entries = entries[~known]
            held.append(entries)
            size += len(entries)
            if size < most:
                continue
            if at >= buckets:
                whole = np.concatenate(held)
                yield _out(False, *_chained(whole))
                # A point's least near entry, or without one all that it has, stands for the rest.
                whole = _unique(whole)
                base, far = whole[:, 0] >> 1, whole[:, 0] & 1
                first = np.append(True, base[1:] != base[:-1])
                lead = np.repeat(far[first] == 0, np.diff(np.append(np.flatnonzero(first), len(base))))
                held = [whole[first | ~lead]]
            else:
                rest, many = _without_crowds(_unique(np.concatenate(held)), crowd)
                if len(many):
                    yield _out(True, many[:, 0], many[:, 1])
                    hot = np.union1d(hot, many[:, 0] >> 1)
                held = [rest]
            size = 0
        if held and at >= buckets:
            yield _out(False, *_chained(np.concatenate(held)))
        elif held:
            yield from _joined(_unique(np.concatenate(held)), tau, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((at, np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3)) for batch in batches for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for at, group in itertools.groupby(rows, lambda r: r[0]):
            yield from bucket_of(at, (entries for _, entries in group))

    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "crowded boolean, a long, b long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, chars_per_edit: int = 5, crowd: int = 256, held: int = 2_000_000) -> DataFrame:
    """(id_col, line_no, class_id, class_line_no, kept): a row for each line with a word of each row of docs.

    line_no counts all lines of the text from 0. Lines are of one class if links connect them: equal lines, and lines with an
    edit between them for each `chars_per_edit` code points of the longer or fewer, up to `tau` (1 or 2). So with 5, a similarity
    of 0.8 or more is asked of all lines, and those of fewer than 5 have to be equal. (class_id, class_line_no) is the first line
    of the class by id and number, and kept marks that line. Null texts have no lines; null ids come first; rows of docs that
    repeat give rows each, of which all with the first id and number are kept; other columns are ignored; an empty table gives an
    empty result. Lines of any length are taken whole. `crowd` and `held` (entries of a bucket that a task keeps before it gives up
    those of crowded keys) choose the way, not the result. The result reads two tables in the shared folder: drop_cut() deletes them.
    """
    if tau not in (1, 2) or chars_per_edit < 3:
        raise ValueError("tau is 1 or 2, chars_per_edit 3 or more")
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    low = tau * chars_per_edit  # lines of so many code points may have all edits

    def edits(size: int) -> int:
        return min(tau, size // chars_per_edit)

    def list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, nodes = [], [], []
            for doc_id, x in zip(batch.column(0), batch.column(1), strict=True):
                i = doc_id.as_py()
                for k, line in _lines(x.as_py()):
                    ids.append(i)
                    numbers.append(k)
                    nodes.append(_node(line))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int64()), pa.array(nodes, pa.binary())], names=["id", "line_no", "node"])

    def distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, str]]]:
        """For each batch (node, line) of the lines that may have a link; a task gives a line once, or seldom more often."""
        seen: set[bytes] = set()
        for batch in batches:
            found = []
            for x in batch.column(0):
                for _, line in _lines(x.as_py()):
                    if len(line) >= chars_per_edit - 1 and (node := _node(line)) not in seen:
                        seen.add(node)
                        found.append((node, line))
            if len(seen) > 500_000:
                seen.clear()
            yield found

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in distinct_lines(batches):
            keys, probes, points, ids = [], [], [], []
            for node, line in found:
                if tau > 1 and len(line) < low:
                    points.append(point_keys(line, 0, edits(len(line))))
                    ids.append(np.full(len(points[-1]), _short(node)))
            found = [x for x in found if len(x[1]) >= low - tau]
            for _, line in found:
                keys += keys_of(line, tau, 0, False)
                probes.append(keys_of(line, tau, 0, True) if len(line) >= low else [])
            shorts, sketches = np.array([_short(node) for node, _ in found], np.int64), counts([line for _, line in found])
            many = [len(p) for p in probes]
            every = np.concatenate((_roled(keys, 0), _roled(list(itertools.chain.from_iterable(probes)), 1)))
            each = lambda x: np.concatenate((np.repeat(x, tau + 1), np.repeat(x, many)))
            yield _blobs(every, each(shorts), each(sketches), buckets, crowd, (_joint(points), _joint(ids)))

    def find_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in distinct_lines(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_short(node) for node, _ in found], pa.int64()), pa.array([line for _, line in found], pa.string())], names=["short", "line"])

    def descend(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
        """What is left of a line without the segment that it met others at, for each crowded key that it has.

        `before` is the key of the segment before, at the same shift, if the line has that too.
        """
        for batch in batches:
            out: list[tuple[int, int, int, bytes, int, int, int | None]] = []
            for short, prefix, role, raw, size, crowded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest, wanted = raw.decode("utf-8", "surrogatepass"), set(crowded)
                for as_probe, make in ((0, index_keys), (1, probe_keys)):
                    if role not in (as_probe, -1) or (as_probe and size < low):
                        continue
                    every = list(make(rest, tau, prefix))
                    mine = {key for key, _, _ in every}
                    for key, at, n in every:
                        if (key << 1 & _MASK | as_probe) not in wanted:
                            continue
                        before = _key_before(rest, tau, prefix, key, at, n, as_probe)
                        left = rest[:at] + mark + rest[at + n :]
                        out.append((short, (key & _MASK >> 1) + 1, as_probe, left.encode("utf-8", "surrogatepass"), size, len(left), before if before in mine else None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["short", "prefix", "role", "rest", "size", "chars", "before"])

    def sign_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sketched, keys, points, ids = [], [], [], [], []
            for short, prefix, role, raw, size, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = raw.decode("utf-8", "surrogatepass")
                # All under a prefix go the same way: their marks are as many, and the shortest decides.
                if least - sum(_MARK <= ord(c) < _MARK + 0x800 for c in rest) <= _POINT_CHARS:
                    points.append(point_keys(rest, prefix, tau if size >= low else 0, least))
                    ids.append(np.full(len(points[-1]), short))
                    continue
                keys.append(_roled(keys_of(rest, tau, prefix, bool(role)), role))
                lines.append(short)
                sketched.append(rest)
            many = [len(k) for k in keys]
            yield _blobs(_joint(keys), np.repeat(np.array(lines, np.int64), many), np.repeat(counts(sketched), many), buckets, crowd, (_joint(points), _joint(ids)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_node(a), _node(b)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if within(a, b, edits(max(len(a), len(b))))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

    with scratch(spark) as keep:
        listed = cut(rows.mapInArrow(list_lines, f"id {kind}, line_no long, node binary"), "lines")
        total = listed.count()
        # A line's entries take under a kilobyte, so a task gets 64 MB or so, however many lines there are.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 65536)
        buckets = 8 * parts
        met = cut(_meet(rows.select("text").mapInArrow(sign, "bucket long, blob binary"), parts, buckets, tau, crowd, held), "met")
        texts = rows.select("text").mapInArrow(find_texts, "short long, line string")
        every, level, state = met.where("not crowded").select("a", "b"), 0, None
        while not met.where("crowded").isEmpty():
            mark, level = chr(_MARK + level), level + 1
            crowded = met.where("crowded").groupBy(F.col("b").alias("short")).agg(F.collect_set("a").alias("keys"))
            if state is None:
                state = texts.join(crowded.select("short"), "short", "left_semi").distinct()
                state = state.select("short", F.lit(0).cast("long").alias("prefix"), F.lit(-1).alias("role"), F.col("line").cast("binary").alias("rest"), F.length("line").cast("long").alias("size"))
            down = state.join(crowded, "short").select("short", "prefix", "role", "rest", "size", "keys")
            down = cut(down.mapInArrow(lambda batches, mark=mark: descend(batches, mark), "short long, prefix long, role int, rest binary, size long, chars long, before long").distinct(), "down")
            # Where all have the segment before in common too, that key's lines are these and more.
            groups = down.groupBy("prefix").agg(F.count("*").alias("n"), F.count("before").alias("n_before"), F.min("before").alias("lo"), F.max("before").alias("hi"), F.min("role").alias("index"), F.max("role").alias("probe"), F.min("chars").alias("least"))
            groups = cut(groups.where("index = 0 and probe = 1 and (n_before < n or lo != hi)").select("prefix", "least", "n"), "groups")
            several = crowded_keys(groups, "prefix", "n", total)
            state = join_once(down, groups.select("prefix", "least"), "prefix", several).where("least is not null")
            state = cut(state.select("short", "prefix", "role", "rest", "size", "least").distinct(), "state")
            met = cut(_meet(state.mapInArrow(sign_rest, "bucket long, blob binary"), parts, buckets, tau, crowd, held), "met")
            every = every.union(met.where("not crowded").select("a", "b"))
        every = cut(every.distinct(), "pairs")
        # A merge join at every size, so that small tables show what large ones cost.
        wanted = every.select(F.explode(F.array("a", "b")).alias("short")).distinct()
        lines = cut(texts.join(wanted.hint("merge"), "short", "left_semi").distinct(), "texts")
        one = every.join(lines.select(F.col("short").alias("a"), F.col("line").alias("line_a")), "a")
        two = one.join(lines.select(F.col("short").alias("b"), F.col("line").alias("line_b")), "b").select("line_a", "line_b")
        linked = components(two.mapInArrow(verify, "a binary, b binary")).select("node", F.col("root").alias("class"))
        # Most lines are alone in their class; the others' classes and first places are found by distinct lines.
        several = listed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        marks = cut(several.join(linked, "node", "full_outer").select("node", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("class", "node").alias("class")), "marks")
        placed = join_once(listed, marks.select("node", "class"), "node", crowded_keys(marks, "node", "n", total)).where("class is not null")
        firsts = cut(placed.groupBy("class").agg(F.min(F.struct("id", "line_no")).alias("first")), "firsts")
        members = marks.groupBy("class").agg(F.count("*").alias("members"))
        named = cut(join_once(marks, firsts, "class", crowded_keys(members, "class", "members", total)).select("node", "n", "first"), "named")
        place = F.struct("id", "line_no")
        out = join_once(listed, named.select("node", "first"), "node", crowded_keys(named, "node", "n", total)).withColumn("first", F.coalesce("first", place))
        out = out.select(F.col("id").alias(id_col), "line_no", F.col("first.id").alias("class_id"), F.col("first.line_no").alias("class_line_no"), place.eqNullSafe(F.col("first")).alias("kept"))
        return keep(out, listed, named)
