"""Linearized files: the first page and what it needs come first, with tables that tell where the other pages are."""

from __future__ import annotations

from typing import Any

from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Ref, references, renumber, write
from docloom.sources.pdf.writer import deflated, reachable


class _Bits:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value, self.size = self.value << n | value, self.size + n

    def align(self) -> None:
        self.put(0, -self.size % 8)

    def done(self) -> bytes:
        self.align()
        return self.value.to_bytes(self.size // 8, "big")


def _closure(objects: dict[int, Any], start: list[int], avoid: set[int]) -> list[int]:
    """Objects that the start reaches, in the order they are found."""
    out, work = [], list(start)
    seen = set(avoid)
    while work:
        n = work.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        out.append(n)
        work += sorted(r.num for r in references(objects[n]))
    return out


def _one(n: int, value: Any) -> bytes:
    return b"%d 0 obj\n" % n + write(value) + b"\nendobj\n"


def _entries(where: dict[int, int], first: int, count: int) -> bytes:
    return b"".join(b"%010d %05d %s \n" % ((where[n], 0, b"n") if n else (0, 65535, b"f")) for n in range(first, first + count))


def linearize(doc: Document) -> bytes | None:
    """The document written anew in that order, with hint tables; null without pages. Encryption isn't kept."""
    leaves = doc.pages()
    root = doc.trailer.get("Root")
    if not leaves or not isinstance(root, Ref) or any(r is None for r, _ in leaves):
        return None
    objects = reachable(doc, [r for k in ("Root", "Info") if isinstance(r := doc.trailer.get(k), Ref)])
    # Pages have all that they inherit, so that a page needs no other node.
    for ref, page in leaves:
        objects[ref.num] = {k: v for k, v in page.items() if k != "Parent"} | ({"Parent": objects[ref.num]["Parent"]} if "Parent" in objects[ref.num] else {})
    page_nums = [r.num for r, _ in leaves]
    nodes = {n for n, v in objects.items() if isinstance(v, dict) and v.get("Type") in ("Pages", "Catalog")} | {root.num}
    others = lambda i: (set(page_nums) - {page_nums[i]}) | nodes
    uses = [_closure(objects, [n], others(i)) for i, n in enumerate(page_nums)]
    first = uses[0]
    users: dict[int, int] = {}
    for part in uses[1:]:
        for n in part:
            users[n] = users.get(n, 0) + 1
    private = [[n for n in part if users[n] == 1 and n not in first] for part in uses[1:]]
    shared = sorted(n for n, k in users.items() if k > 1 and n not in first)
    placed = {root.num, *first, *shared, *(n for part in private for n in part)}
    rest = sorted(set(objects) - placed)
    # The second section has the low numbers, the first one those after them.
    second = [n for part in private for n in part] + shared + rest
    k = len(second) + 1
    order = [root.num, *first]
    lin, hints = k, k + 1
    to = {n: i for i, n in enumerate(second, 1)} | {n: k + 2 + i for i, n in enumerate(order)}
    new = {to[n]: renumber(v, to) for n, v in objects.items()}
    total = k + 2 + len(order)
    trailer = renumber({key: v for key, v in doc.trailer.items() if key in ("Root", "Info", "ID")}, to)
    bodies = {n: _one(n, v) for n, v in new.items()}
    header = b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"
    number = lambda v: b"%010d" % v

    def parameters(length: int, at: int, size: int, end: int, main: int) -> bytes:
        return b"%d 0 obj\n<</Linearized 1/L %s/H[%s %s]/O %d/E %s/N %d/T %s>>\nendobj\n" % (lin, number(length), number(at), number(size), to[page_nums[0]], number(end), len(page_nums), number(main))

    def first_table(where: dict[int, int], main: int) -> bytes:
        head = write({"Size": total, "Prev": 0} | trailer).replace(b"/Prev 0", b"/Prev " + number(main))
        return b"xref\n%d %d\n" % (k, total - k) + _entries(where, k, total - k) + b"trailer\n" + head + b"\nstartxref\n0\n%%EOF\n"

    fixed = len(header) + len(parameters(0, 0, 0, 0, 0)) + len(first_table(dict.fromkeys(range(k, total), 0), 0))
    # As the tables ask, places in them are those without the hint stream.
    where, at = {lin: len(header)}, fixed
    for n in order[:1]:
        where[to[n]], at = at, at + len(bodies[to[n]])
    hint_at = at
    for n in order[1:]:
        where[to[n]], at = at, at + len(bodies[to[n]])
    end_first = at
    for n in range(1, k):
        where[n], at = at, at + len(bodies[n])
    size = lambda part: sum(len(bodies[to[n]]) for n in part)
    parts = [first, *private]
    counts, lengths = [len(p) for p in parts], [size(p) for p in parts]
    groups = [*first, *shared]  # one object each: those of the first page, then those that others share
    of = {n: i for i, n in enumerate(groups)}
    refs = [[], *[sorted(of[n] for n in part if n in of) for part in uses[1:]]]
    bits = _Bits()
    need = lambda values: max(values, default=0).bit_length()
    low_count, low_length = min(counts), min(lengths)
    b_count, b_length = need([c - low_count for c in counts]), need([v - low_length for v in lengths])
    b_refs, b_id = need([len(r) for r in refs]), need([v for r in refs for v in r])
    for value, n in ((low_count, 32), (where[to[page_nums[0]]], 32), (b_count, 16), (low_length, 32), (b_length, 16), (0, 32), (0, 16), (low_length, 32), (b_length, 16), (b_refs, 16), (b_id, 16), (0, 16), (1, 16)):
        bits.put(value, n)
    for values, n in (([c - low_count for c in counts], b_count), ([v - low_length for v in lengths], b_length), ([len(r) for r in refs], b_refs), ([v for r in refs for v in r], b_id)):
        for v in values:
            bits.put(v, n)
        bits.align()
    for v in lengths:  # content lengths, as those of whole pages
        bits.put(v - low_length, b_length)
    bits.align()
    page_table = bits.done()
    bits = _Bits()
    sizes = [len(bodies[to[n]]) for n in groups]
    low_size = min(sizes)
    b_size = need([v - low_size for v in sizes])
    begin = to[shared[0]] if shared else 0
    for value, n in ((begin, 32), (where[begin] if shared else 0, 32), (len(first), 32), (len(groups), 32), (0, 16), (low_size, 32), (b_size, 16)):
        bits.put(value, n)
    for v in sizes:
        bits.put(v - low_size, b_size)
    bits.align()
    for _ in sizes:  # no signatures
        bits.put(0, 1)
    stream = _one(hints, deflated(page_table + bits.done(), S=len(page_table)))
    where = {n: v + (len(stream) if v >= hint_at else 0) for n, v in where.items()} | {hints: hint_at}
    end_first, main = end_first + len(stream), at + len(stream)
    main_head = b"xref\n0 %d\n" % k
    tail = main_head + _entries(where, 0, k) + b"trailer\n" + write({"Size": k}) + b"\nstartxref\n%d\n%%%%EOF\n" % (len(header) + len(parameters(0, 0, 0, 0, 0)))
    out = header + parameters(main + len(tail), hint_at, len(stream), end_first, main + len(main_head) - 1) + first_table(where, main)
    out += b"".join(bodies[to[n]] for n in order[:1]) + stream + b"".join(bodies[to[n]] for n in order[1:]) + b"".join(bodies[n] for n in range(1, k))
    return out + tail


def is_linearized(doc: Document) -> bool:
    """Whether the file's first object says so, and of this length."""
    first = min(doc.xref.items(), key=lambda x: x[1].offset if x[1].kind == "offset" and x[1].offset > 0 else 1 << 60, default=None)
    d = doc.get(Ref(first[0])) if first else None
    return isinstance(d, dict) and d.get("Linearized") is not None and d.get("L") == len(doc.data)


