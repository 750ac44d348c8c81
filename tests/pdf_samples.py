"""Small documents built in code."""

from palimpsest.sources.pdf_syntax import Document, Name, Ref, Stream, write_document


def sample(contents: list[bytes], fonts=None, images=None, media_box=(0, 0, 612, 792), inherit_box=False) -> bytes:
    """A document with a page for each content stream."""
    doc = Document()
    add = lambda v: doc.objects.setdefault(len(doc.objects) + 1, v) is v and Ref(len(doc.objects))
    pages = {"Type": Name("Pages"), "Kids": [], "Count": len(contents)}
    pages_ref = add(pages)
    doc.trailer["Root"] = add({"Type": Name("Catalog"), "Pages": pages_ref})
    resources = {}
    if fonts:
        resources["Font"] = {k: add(v) for k, v in fonts.items()}
    if images:
        resources["XObject"] = {k: add(v) for k, v in images.items()}
    resources_ref = add(resources or {"ProcSet": []})
    if inherit_box:
        pages["MediaBox"] = list(media_box)
    for data in contents:
        page = {"Type": Name("Page"), "Parent": pages_ref, "Resources": resources_ref, "Contents": add(Stream({}, data))}
        if not inherit_box:
            page["MediaBox"] = list(media_box)
        pages["Kids"].append(add(page))
    return write_document(doc)


DEJAVU = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("DejaVuSans"), "Encoding": Name("WinAnsiEncoding")}
UNKNOWN = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("NoSuchFace")}


def gray_image(w=100, h=100, value=7):
    return Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, bytes([value]) * (w * h))
