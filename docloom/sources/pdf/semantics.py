"""What a document says of itself: metadata, outline, labels, links, fields, attachments, layers, scripts."""

from __future__ import annotations

from typing import Any

from docloom.sources.pdf.document import Document
from docloom.sources.pdf.objects import Name, Ref, Stream

# Field flags (bit positions from 0).
RADIO, PUSHBUTTON, COMBO, MULTILINE, READ_ONLY = 15, 16, 17, 12, 0
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")


def metadata(doc: Document) -> dict[str, str | None]:
    """Absent entries are null; present and blank ones are empty."""
    info = doc.get(doc.trailer.get("Info"))
    info = info if isinstance(info, dict) else {}
    return {k: doc.text(info.get(k)) for k in (*INFO_KEYS, "Trapped")}


def xmp(doc: Document) -> bytes | None:
    stream = doc.get(doc.catalog().get("Metadata"))
    return doc.decoded(stream)[0] if isinstance(stream, Stream) else None


class Targets:
    """Destinations and actions; pages by number."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.numbers = {ref: i for i, (ref, _) in enumerate(doc.pages()) if ref}
        names = doc.get(doc.catalog().get("Names"))
        tree = doc.name_tree(names.get("Dests")) if isinstance(names, dict) else []
        old = doc.get(doc.catalog().get("Dests"))
        self.named = {k.encode("utf-8", "surrogateescape"): v for k, v in old.items()} if isinstance(old, dict) else {}
        self.named |= dict(tree)  # the name tree goes before the old dictionary

    def page(self, value: Any, depth: int = 0) -> tuple[int | None, str | None]:
        """(page, kind of fit) of an explicit or named destination."""
        value = self.doc.get(value) if not isinstance(value, Ref) or value not in self.numbers else value
        if isinstance(value, (bytes, Name)) and depth < 8:
            key = value if isinstance(value, bytes) else value.encode("utf-8", "surrogateescape")
            return self.page(self.named.get(key), depth + 1)
        if isinstance(value, dict) and depth < 8:
            return self.page(value.get("D"), depth + 1)
        if isinstance(value, list) and value:
            at = value[0]
            kind = self.doc.get(value[1]) if len(value) > 1 else None
            number = self.numbers.get(at) if isinstance(at, Ref) else at if isinstance(at, int) else None
            return number, str(kind) if isinstance(kind, Name) else None
        return None, None

    def action(self, value: Any) -> tuple[str | None, str | None, int | None]:
        """(kind, target, page); launching and scripts are told, never done."""
        d = self.doc.get(value)
        if not isinstance(d, dict):
            return None, None, None
        kind = self.doc.get(d.get("S"))
        if kind == "GoTo":
            return "GoTo", None, self.page(d.get("D"))[0]
        if kind == "URI":
            uri = self.doc.get(d.get("URI"))
            return "URI", uri.decode("utf-8", "replace") if isinstance(uri, bytes) else None, None
        if kind in ("GoToR", "Launch"):
            file = self.doc.get(d.get("F"))
            file = self.doc.get(file.get("UF", file.get("F"))) if isinstance(file, dict) else file
            return str(kind), self.doc.text(file), None
        if kind == "Named":
            return "Named", str(self.doc.get(d.get("N")) or ""), None
        return str(kind) if isinstance(kind, Name) else None, None, None


def outline(doc: Document) -> list[dict[str, Any]]:
    """(node, parent, depth, title, page) depth first; items that were seen end a level."""
    targets, out, seen = Targets(doc), [], set()
    root = doc.get(doc.catalog().get("Outlines"))
    work = [(root.get("First"), -1, 0)] if isinstance(root, dict) else []
    while work and len(out) < 1 << 20:
        at, parent, depth = work.pop()
        item = doc.get(at)
        if not isinstance(item, dict) or (isinstance(at, Ref) and at in seen) or depth > 128:
            continue
        seen.add(at if isinstance(at, Ref) else id(item))
        page = targets.page(item.get("Dest"))[0] if item.get("Dest") is not None else targets.action(item.get("A"))[2]
        node = len(out)
        out.append({"node": node, "parent": parent, "depth": depth, "title": doc.text(item.get("Title")) or "", "page": page})
        work.append((item.get("Next"), parent, depth))
        work.append((item.get("First"), node, depth + 1))
    return out


def label_ranges(doc: Document) -> list[dict[str, Any]]:
    """(page, style, prefix, start): from each page on."""
    out = []
    for page, value in doc.name_tree(doc.catalog().get("PageLabels"), numbers=True):
        d = doc.get(value)
        if isinstance(d, dict):
            start = doc.get(d.get("St"))
            out.append({"page": page, "style": str(doc.get(d.get("S")) or ""), "prefix": doc.text(d.get("P")) or "", "start": start if isinstance(start, int) and start > 0 else 1})
    return sorted(out, key=lambda r: r["page"])


def links(doc: Document) -> list[dict[str, Any]]:
    """Link annotations in order; a destination goes before an action."""
    targets, out = Targets(doc), []
    for number, (_, page) in enumerate(doc.pages()):
        annots = doc.get(page.get("Annots"))
        for seq, at in enumerate(annots if isinstance(annots, list) else []):
            d = doc.get(at)
            if not isinstance(d, dict) or doc.get(d.get("Subtype")) != "Link":
                continue
            box = doc.box(d, "Rect") or (None, None, None, None)
            kind, target, to = ("GoTo", None, targets.page(d["Dest"])[0]) if d.get("Dest") is not None else targets.action(d.get("A"))
            out.append({"page": number, "seq": seq, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "action": kind, "target": target, "to_page": to})
    return out


def field_kind(kind: Any, flags: int) -> str:
    if kind == "Btn":
        return "pushbutton" if flags >> PUSHBUTTON & 1 else "radio" if flags >> RADIO & 1 else "checkbox"
    if kind == "Ch":
        return "combo" if flags >> COMBO & 1 else "list"
    return {"Tx": "text", "Sig": "signature"}.get(kind, "unknown")


def fields(doc: Document) -> list[dict[str, Any]]:
    """Terminal fields with dotted names; type, flags, value, default and appearance are inherited."""
    form = doc.get(doc.catalog().get("AcroForm"))
    if not isinstance(form, dict):
        return []
    order = [r for r in doc.get(form.get("CO")) or [] if isinstance(r, Ref)]
    out, seen = [], set()
    roots = doc.get(form.get("Fields"))
    work = [(r, "", {}) for r in reversed(roots)] if isinstance(roots, list) else []
    while work:
        at, prefix, above = work.pop()
        d = doc.get(at)
        if not isinstance(d, dict) or (isinstance(at, Ref) and at in seen):
            continue
        seen.add(at)
        part = doc.text(d.get("T"))
        name = ".".join(x for x in (prefix, part) if x)
        own = above | {k: d[k] for k in ("FT", "Ff", "V", "DV", "DA", "MaxLen", "Opt") if k in d}
        kids = doc.get(d.get("Kids"))
        named = [k for k in kids if isinstance(doc.get(k), dict) and "T" in doc.get(k)] if isinstance(kids, list) else []
        if named:
            work += [(k, name, own) for k in reversed(named)]
            continue
        flags = doc.get(own.get("Ff"))
        flags = flags if isinstance(flags, int) else 0
        kind = field_kind(doc.get(own.get("FT")), flags)
        value = doc.get(own.get("V"))
        if isinstance(value, Stream):
            value = doc.decoded(value)[0]
        many = [doc.text(v) or "" for v in value] if isinstance(value, list) else None
        text = None if many is not None else doc.text(value) if value is not None else "Off" if kind in ("checkbox", "radio") else None
        options = []
        for o in doc.get(own.get("Opt")) or []:
            o = doc.get(o)
            options.append(doc.text(o[1]) or "" if isinstance(o, list) and len(o) > 1 else doc.text(o) or "")
        actions = doc.get(d.get("AA"))
        scripts = {k: _script(doc, actions.get(k)) for k in "CFKV" if _script(doc, actions.get(k)) is not None} if isinstance(actions, dict) else {}
        most = doc.get(own.get("MaxLen"))
        out.append({"seq": len(out), "num": at.num if isinstance(at, Ref) else None, "name": name, "kind": kind, "value": text, "many": many, "default": doc.text(own.get("DV")), "flags": flags, "options": options, "max_len": most if isinstance(most, int) else None, "calculated": order.index(at) if at in order else None, "scripts": scripts})
    return out


def _script(doc: Document, value: Any) -> str | None:
    d = doc.get(value)
    if not isinstance(d, dict) or doc.get(d.get("S")) != "JavaScript":
        return None
    js = doc.get(d.get("JS"))
    return doc.text(doc.decoded(js)[0][:65536] if isinstance(js, Stream) else js)


def scripts(doc: Document) -> list[dict[str, Any]]:
    """Scripts of the document and of its fields, by place."""
    out = []
    names = doc.get(doc.catalog().get("Names"))
    for key, value in doc.name_tree(names.get("JavaScript")) if isinstance(names, dict) else []:
        out.append({"place": "document", "name": doc.text(key), "source": _script(doc, value)})
    actions = doc.get(doc.catalog().get("AA"))
    for key in actions if isinstance(actions, dict) else []:
        out.append({"place": "catalog", "name": str(key), "source": _script(doc, actions[key])})
    for f in fields(doc):
        out += [{"place": f"field {k}", "name": f["name"], "source": s} for k, s in f["scripts"].items()]
    return [r for r in out if r["source"] is not None]


def attachments(doc: Document) -> list[dict[str, Any]]:
    """Embedded files; their bytes stay where they are until payload() asks."""
    names, out = doc.get(doc.catalog().get("Names")), []
    for key, value in doc.name_tree(names.get("EmbeddedFiles")) if isinstance(names, dict) else []:
        spec = doc.get(value)
        if not isinstance(spec, dict):
            continue
        ef = doc.get(spec.get("EF"))
        ref = ef.get("UF", ef.get("F")) if isinstance(ef, dict) else None
        stream = doc.get(ref)
        params = doc.get(stream.dict.get("Params")) if isinstance(stream, Stream) else None
        size = doc.get(params.get("Size")) if isinstance(params, dict) else None
        out.append({"name": doc.text(key), "file": doc.text(spec.get("UF", spec.get("F"))), "description": doc.text(spec.get("Desc")), "mime": str(doc.get(stream.dict.get("Subtype")) or "") or None if isinstance(stream, Stream) else None, "size": size if isinstance(size, int) else None, "num": ref.num if isinstance(ref, Ref) else None})
    return out


def payload(doc: Document, num: int) -> bytes | None:
    stream = doc.get(Ref(num))
    return doc.decoded(stream)[0] if isinstance(stream, Stream) else None


def layers(doc: Document) -> list[dict[str, Any]]:
    """Optional content groups with their default state: the base state, then what is listed as on, then as off."""
    props = doc.get(doc.catalog().get("OCProperties"))
    if not isinstance(props, dict):
        return []
    config = doc.get(props.get("D"))
    config = config if isinstance(config, dict) else {}
    listed = lambda k: [r for r in doc.get(config.get(k)) or [] if isinstance(r, Ref)]
    base = doc.get(config.get("BaseState")) != "OFF"
    on, off, out = listed("ON"), listed("OFF"), []
    for ref in doc.get(props.get("OCGs")) or []:
        d = doc.get(ref)
        if isinstance(d, dict):
            out.append({"num": ref.num if isinstance(ref, Ref) else None, "name": doc.text(d.get("Name")) or "", "visible": False if ref in off else True if ref in on else base})
    return out


def visible(doc: Document, membership: dict[str, Any], states: dict[int, bool]) -> bool:
    """Whether a group or a membership dictionary shows; an expression goes before a policy, what can't be told shows."""
    expression = doc.get(membership.get("VE"))
    if isinstance(expression, list) and (found := _evaluate(doc, expression, states, 0)) is not None:
        return found
    groups = membership.get("OCGs")
    groups = groups if isinstance(groups, list) else [groups]
    known = [states[g.num] for g in groups if isinstance(g, Ref) and g.num in states]
    if not known:
        return True
    policy = doc.get(membership.get("P"))
    return {"AllOn": all(known), "AnyOff": not all(known), "AllOff": not any(known)}.get(policy, any(known))


def _evaluate(doc: Document, items: list, states: dict[int, bool], depth: int) -> bool | None:
    if depth > 16 or not items:
        return None
    values = []
    for x in items[1:]:
        if isinstance(x, Ref) and x.num in states:
            values.append(states[x.num])
        else:
            inner = doc.get(x)
            values.append(_evaluate(doc, inner, states, depth + 1) if isinstance(inner, list) else None)
    values = [True if v is None else v for v in values]
    match doc.get(items[0]):
        case "And":
            return all(values)
        case "Or":
            return any(values)
        case "Not":
            return not values[0] if values else None
    return None


def capabilities(doc: Document) -> list[str]:
    """Features that objects of the file name."""
    out = set()
    for _, _, value in doc.objects():
        d = value.dict if isinstance(value, Stream) else value
        if isinstance(d, dict):
            names = d.get("Filter")
            for f in names if isinstance(names, list) else [names]:
                out |= {{"JBIG2Decode": "jbig2", "JPXDecode": "jpx", "DCTDecode": "jpeg", "CCITTFaxDecode": "ccitt"}.get(f)} if isinstance(f, str) else set()
            if d.get("ShadingType") in (4, 5, 6, 7):
                out.add("mesh-shading")
            if d.get("Type") == "OCG":
                out.add("layers")
    return sorted(out - {None})
