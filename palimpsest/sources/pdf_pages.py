"""Pages of a document, and documents made of pages."""

from __future__ import annotations

import zlib
from typing import Any

from palimpsest.functions import content
from palimpsest.sources.pdf_syntax import Document, Name, Ref, Stream, SyntaxFault, number_text

#: The largest page side, in points.
LARGEST_SIDE = 14_400


def page_size(doc: Document, page: dict) -> tuple[float, float]:
    """Width and height by the media box, the page's own or inherited."""
    box = doc.inherited(page, "MediaBox")
    values = [doc.get(v) for v in box] if isinstance(box, list) else []
    if len(values) < 4 or not all(isinstance(v, int | float) and not isinstance(v, bool) for v in values[:4]):
        raise SyntaxFault("no usable media box")
    w, h = abs(values[2] - values[0]), abs(values[3] - values[1])
    if not 0 < w <= LARGEST_SIDE or not 0 < h <= LARGEST_SIDE:
        raise SyntaxFault("page size out of range")
    return float(w), float(h)


def page_content(doc: Document, page: dict) -> bytes:
    """The decoded streams of a page, one after another."""
    held = doc.get(page.get("Contents"))
    parts = [doc.get(x) for x in held] if isinstance(held, list) else [held]
    return b"\n".join(doc.decoded(p) for p in parts if isinstance(p, Stream))


def image_streams(doc: Document, page: dict) -> dict[str, Stream]:
    """Image XObjects of a page by name."""
    resources = doc.inherited(page, "Resources") or {}
    held = doc.get(resources.get("XObject")) or {}
    found = {name: doc.get(ref) for name, ref in held.items()}
    return {n: s for n, s in sorted(found.items()) if isinstance(s, Stream) and doc.get(s.dict.get("Subtype")) == "Image"}


class Writer:
    """Builds a document page by page; an object of a source is copied once."""

    def __init__(self):
        self.doc = Document()
        self.kids: list[Ref] = []
        self.pages = self.add({"Type": Name("Pages"), "Kids": self.kids, "Count": 0})
        self.doc.trailer["Root"] = self.add({"Type": Name("Catalog"), "Pages": self.pages})
        self.copies: dict[tuple[int, int], Ref] = {}
        self.masked: list[int] = []

    def add(self, value: Any) -> Ref:
        ref = Ref(len(self.doc.objects) + 1)
        self.doc.objects[ref.id] = value
        return ref

    def _append(self, page: dict) -> Ref:
        page["Parent"] = self.pages
        ref = self.add(page)
        self.kids.append(ref)
        self.doc.objects[self.pages.id]["Count"] = len(self.kids)
        return ref

    def copied(self, source: Document, value: Any) -> Any:
        """value with all it refers to, copied; parent links are left out. A
        number is given before what it holds is copied, so cycles end."""
        if isinstance(value, Ref):
            key = (id(source), value.id)
            if key not in self.copies:
                self.copies[key] = self.add(None)
                self.doc.objects[self.copies[key].id] = self.copied(source, source.objects.get(value.id))
            return self.copies[key]
        if isinstance(value, dict):
            return {k: self.copied(source, v) for k, v in value.items() if k != "Parent"}
        if isinstance(value, list):
            return [self.copied(source, v) for v in value]
        if isinstance(value, Stream):
            return Stream(self.copied(source, {k: v for k, v in value.dict.items() if k != "Length"}), value.raw)
        return value

    def copy_page(self, source: Document, number: int) -> Ref:
        """A page unchanged; inherited entries become its own."""
        page = dict(source.objects[number])
        for key in ("Resources", "MediaBox", "CropBox", "Rotate"):
            if key not in page and (held := source.inherited(page, key)) is not None:
                page[key] = held
        return self._append(self.copied(source, page))

    def image(self, data: bytes, w: int, h: int, filter_name: str, **entries: Any) -> Ref:
        d = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h}
        return self.add(Stream(d | entries | ({"Filter": Name(filter_name)} if filter_name else {}), data))

    def text_masked(self, source: Document, number: int, out: dict[str, Any]) -> Ref:
        """A page with new content, whitened images and text regions."""
        ref = self.copy_page(source, number)
        page = self.doc.objects[ref.id]
        resources = dict(self.doc.get(page.get("Resources")) or {})
        xobjects = dict(self.doc.get(resources.get("XObject")) or {})
        for name, image in out["images"].items():
            old = self.doc.get(xobjects.get(name))
            if isinstance(old, Stream):
                d = {k: v for k, v in old.dict.items() if k not in ("Filter", "DecodeParms", "Length")}
                d |= {"ColorSpace": Name(image["space"]), "BitsPerComponent": image["bits"]}
                if image["filter"]:
                    d["Filter"] = Name(image["filter"])
                xobjects[name] = self.add(Stream(d, image["data"]))
        body = out["content"]
        for i, region in enumerate(out["regions"]):
            name = f"TxtRgn{i}"
            xobjects[name] = self.image(region["data"], region["w"], region["h"], "JBIG2Decode", ImageMask=True, BitsPerComponent=1, Decode=[1, 0])
            x0, y0, x1, y1 = region["box"]
            place = " ".join(map(number_text, (x1 - x0, 0, 0, y1 - y0, x0, y0)))
            body += f"\nq 0 g {place} cm /{name} Do Q".encode()
        resources["XObject"] = xobjects
        page["Resources"] = self.add(resources)
        page["Contents"] = self.add(Stream({}, body))
        self.masked.append(ref.id)
        return ref

    def _raster_page(self, images: dict[str, Ref], body: str, w: float, h: float) -> Ref:
        page = {"Type": Name("Page"), "MediaBox": [0, 0, w, h], "Resources": {"XObject": images}, "Contents": self.add(Stream({}, body.encode()))}
        ref = self._append(page)
        self.masked.append(ref.id)
        return ref

    def layered(self, out: dict[str, Any], w: float, h: float) -> Ref:
        """Background, and foreground through the mask."""
        gray = {"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 1, "Decode": [0, 1]}
        color = {"ColorSpace": Name(out["space"]), "BitsPerComponent": 8}
        mask = self.image(out["mask"], out["w"], out["h"], "JBIG2Decode", **gray)
        bg = self.image(out["bg"], out["w"], out["h"], "DCTDecode", **color)
        fg = self.image(out["fg"], out["w"], out["h"], "DCTDecode", SMask=mask, **color)
        size = f"{number_text(w)} 0 0 {number_text(h)} 0 0 cm"
        return self._raster_page({"BgImg": bg, "FgImg": fg}, f"q {size} /BgImg Do Q q {size} /FgImg Do Q", w, h)

    def bw(self, out: dict[str, Any], w: float, h: float) -> Ref:
        """The mask alone; its ones are black."""
        entries = {"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 1, "Decode": [1, 0]}
        mask = self.image(out["mask"], out["w"], out["h"], "JBIG2Decode", **entries)
        return self._raster_page({"BwImg": mask}, f"q {number_text(w)} 0 0 {number_text(h)} 0 0 cm /BwImg Do Q", w, h)

    def optimize(self) -> None:
        """Fonts off the masked pages, streams deflated, unused objects out."""
        remove_fonts(self.doc, self.masked)
        compress_streams(self.doc)
        prune(self.doc)


def remove_fonts(doc: Document, pages: list[int]) -> None:
    """Drop /Font from these pages; resources that other pages share stay."""
    for number in pages:
        page = doc.objects[number]
        resources = doc.get(page.get("Resources"))
        if isinstance(resources, dict) and "Font" in resources:
            page["Resources"] = {k: v for k, v in resources.items() if k != "Font"}


def compress_streams(doc: Document) -> None:
    for value in doc.objects.values():
        if isinstance(value, Stream) and "Filter" not in value.dict:
            value.raw = zlib.compress(value.raw)
            value.dict["Filter"] = Name("FlateDecode")


def references(value: Any) -> list[int]:
    """Numbers that a value refers to."""
    if isinstance(value, Ref):
        return [value.id]
    if isinstance(value, Stream):
        return references(value.dict)
    if isinstance(value, dict):
        return [r for v in value.values() for r in references(v)]
    if isinstance(value, list):
        return [r for v in value for r in references(v)]
    return []


def prune(doc: Document) -> None:
    """Remove the objects that the trailer does not reach."""
    todo, seen = references(doc.trailer), set()
    while todo:
        number = todo.pop()
        if number not in seen and number in doc.objects:
            seen.add(number)
            todo += references(doc.objects[number])
    doc.objects = {k: v for k, v in doc.objects.items() if k in seen}


__all__ = ["Writer", "compress_streams", "content", "image_streams", "page_content", "page_size", "prune", "references", "remove_fonts"]
