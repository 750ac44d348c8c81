import numpy as np
import pytest

from palimpsest.operators import cache, graph
from palimpsest.plans import pipeline
from palimpsest.sources import fonts, pdf_pages
from palimpsest.sources.pdf_syntax import Name, Ref, Stream, SyntaxFault, read_document, write_document
from tests.pdf_samples import DEJAVU, UNKNOWN, gray_image, sample

TEXT = b"q 1 g 0 0 50 50 re f Q BT /F1 24 Tf 100 700 Td (Hi) Tj ET q 100 0 0 100 0 0 cm /Im0 Do Q"


def _sizes(data):
    doc = read_document(data)
    return [pdf_pages.page_size(doc, doc.objects[n]) for n in doc.pages()]


@pytest.mark.parametrize(
    ("box", "size"), [((0, 0, 595.276, 841.89), (595.276, 841.89)), ((10, 20, 605, 812), (595, 792)), ((612, 792, 0, 0), (612, 792))]
)
def test_page_size(box, size):
    assert _sizes(sample([b""], media_box=box))[0] == pytest.approx(size)
    assert _sizes(sample([b"", b""], media_box=box, inherit_box=True)) == [pytest.approx(size)] * 2


@pytest.mark.parametrize("box", [(0, 0, 0, 10), (0, 0, 20000, 10), (0, 0, 10), (0, 0, Name("x"), 1)])
def test_page_size_faults(box):
    with pytest.raises(SyntaxFault):
        _sizes(sample([b""], media_box=box))


def test_document_round_trip():
    data = sample([TEXT, b"q Q"], {"F1": DEJAVU}, {"Im0": gray_image()})
    doc = read_document(data)
    assert len(doc.pages()) == 2 and pdf_pages.page_content(doc, doc.objects[doc.pages()[0]]) == TEXT
    again = read_document(write_document(doc))
    assert again.objects == doc.objects
    with pytest.raises(SyntaxFault):
        read_document(b"no")


def test_copies_share_and_lose_parents():
    data = sample([b"q", b"Q"], {"F1": DEJAVU})
    source, writer = read_document(data), pdf_pages.Writer()
    for n in source.pages():
        writer.copy_page(source, n)
    fonts_held = [v for v in writer.doc.objects.values() if isinstance(v, dict) and v.get("Subtype") == "TrueType"]
    assert len(fonts_held) == 1 and writer.doc.objects[writer.pages.id]["Count"] == 2


def test_optimize():
    data = sample([b"q " * 100, b"Q"], {"F1": DEJAVU})
    source, writer = read_document(data), pdf_pages.Writer()
    writer.text_masked(source, source.pages()[0], {"content": b"q " * 100, "images": {}, "regions": []})
    writer.copy_page(source, source.pages()[1])
    writer.add({"unused": True})
    writer.optimize()
    doc = read_document(write_document(writer.doc))
    first, second = (doc.objects[n] for n in doc.pages())
    assert "Font" not in doc.get(first["Resources"]) and "Font" in doc.get(second["Resources"])
    assert doc.get(first["Contents"]).dict["Filter"] == "FlateDecode" and pdf_pages.page_content(doc, first) == b"q " * 100
    assert not any(isinstance(v, dict) and "unused" in v for v in doc.objects.values())


def test_fonts():
    doc = read_document(sample([TEXT], {"F1": DEJAVU, "F2": UNKNOWN}))
    found = fonts.page_fonts(doc, doc.objects[doc.pages()[0]])
    assert set(found) == {"F1"} and found["F1"].width(ord("A")) == pytest.approx(684, abs=1) and found["F1"].outline(ord("A"))
    assert fonts.ps_name_parts("TimesNewRomanPS-BoldMT") == ("Times New Roman", True, False)
    assert fonts.cid_widths(doc, [1, [500, 600], 10, 12, 700]) == {1: 500.0, 2: 600.0, 10: 700.0, 11: 700.0, 12: 700.0}
    faces = ({"ps": "X", "family": "Liberation Sans", "bold": True, "italic": False},)
    assert fonts.resolve_system_font("Helvetica-Bold", faces) is faces[0]


def test_differences():
    font = DEJAVU | {"Encoding": {"Differences": [65, Name("zero"), Name("nosuch"), 70, Name("uni0042")]}}
    doc = read_document(sample([b""], {"F1": font}))
    held = fonts.page_fonts(doc, doc.objects[doc.pages()[0]])["F1"]
    assert held.differences == {65: ord("0"), 70: ord("B")}
    assert held.glyph(65) == held.face.glyph_of(ord("0")) and held.glyph(66) == held.face.glyph_of(ord("B"))


def test_names(spark):
    from pyspark.sql import functions as F

    from palimpsest.functions import names

    given = ["zero", "A", "uni00e9", "uniD800", "nosuch", "hyphen", "uni00G0"]
    rows = spark.createDataFrame([(n,) for n in given], "n string").select("n", names.glyph_name(F.col("n")).alias("c")).collect()
    for row in rows:
        point = names.glyph_name_code_point(row.n)
        assert row.c == (None if point is None else chr(point))
    row = spark.range(1).select(names.pdf_name(F.lit("A (é)#/")).alias("p"), names.file_name(F.lit("A_b-1.é")).alias("f"), names.number(F.lit(-0.00001)).alias("z"), names.number(F.lit(2.5)).alias("n")).first()
    assert tuple(row) == ("A#20#28#C3#A9#29#23#2F", "A_b-1%2E%C3%A9", "0", "2.5")
    assert names.win_ansi_code_point(0x80) == 0x20AC and names.win_ansi_code_point(0x81) is None


@pytest.fixture()
def job_folder(tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample([TEXT, TEXT, TEXT], {"F1": DEJAVU}, {"Im0": gray_image()}))
    (tmp_path / "b.pdf").write_bytes(sample([b"BT /F1 9 Tf (x) Tj ET"], {"F1": UNKNOWN}))
    (tmp_path / "jobs.yaml").write_text(
        "jobs:\n- {input: a.pdf, output: out/a.pdf, skip_pages: [2], bw_pages: '3', linearize: false}\n- {input: b.pdf, output: out/b.pdf, linearize: false}\n"
        "- {input: none.pdf, output: out/c.pdf, linearize: false}\n- {input: a.pdf, output: out/d.pdf, rgb_pages: [9], linearize: false}\n"
    )
    (tmp_path / "settings.yaml").write_text("linearize: false\n")
    return tmp_path


def test_jobs_end_to_end(spark, job_folder):
    rows = pipeline.run_jobs(spark, [str(job_folder / "jobs.yaml")], str(job_folder / "cache"))
    assert rows[0]["error"] is None and rows[0]["pages"] == 3
    assert "no renderer" in rows[1]["error"] and "not found" in rows[2]["error"] and "out of range" in rows[3]["error"]
    doc = read_document((job_folder / "out/a.pdf").read_bytes())
    pages = [doc.objects[n] for n in doc.pages()]
    bodies = [pdf_pages.page_content(doc, p) for p in pages]
    assert [b"BT" in b for b in bodies] == [False, True, False] and b" l\n" in bodies[0]
    image = doc.get(doc.get(doc.get(pages[0]["Resources"])["XObject"])["Im0"])
    assert (np.frombuffer(doc.decoded(image), dtype=np.uint8) == 255).sum() == 2500
    kept = doc.get(doc.get(doc.get(pages[1]["Resources"])["XObject"])["Im0"])
    assert doc.decoded(kept) == gray_image().raw
    held = cache.read(spark, str(job_folder / "cache")).count()
    again = pipeline.run_jobs(spark, [str(job_folder / "jobs.yaml")], str(job_folder / "cache"))
    assert again == rows and cache.read(spark, str(job_folder / "cache")).count() == held == 2


def test_renderer(spark, job_folder):
    def render(page_doc, index, dpi):
        bitmap = np.full((792, 612, 4), 255, dtype=np.uint8)
        bitmap[300:310, 100:200, :3] = 0
        return bitmap

    rows = pipeline.run_jobs(spark, [str(job_folder / "jobs.yaml")], render=render)
    assert rows[1]["error"] is None
    doc = read_document((job_folder / "out/b.pdf").read_bytes())
    page = doc.objects[doc.pages()[0]]
    assert pdf_pages.page_content(doc, page).strip() == b"q 0 g 100 0 0 10 100 482 cm /TxtRgn0 Do Q"
    assert isinstance(doc.get(doc.get(doc.get(page["Resources"])["XObject"])["TxtRgn0"]), Stream)


def test_watch(spark, job_folder):
    from palimpsest.streaming.watch import watch

    (job_folder / "in").mkdir()
    (job_folder / "in/x.pdf").write_bytes((job_folder / "a.pdf").read_bytes())
    watch(spark, str(job_folder / "in"), str(job_folder / "done"), str(job_folder / "state")).awaitTermination(120)
    assert len(read_document((job_folder / "done/x.pdf").read_bytes()).pages()) == 3


def test_graph(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 9, 8), (2, 1, 5)], "doc int, src int, dst int")
    roots = spark.createDataFrame([(1, 1)], "doc int, id int")
    assert {r.id for r in graph.reachable(roots, edges).collect()} == {1, 2, 3}
    nodes = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 1, None), (1, 3, 2, None), (1, 4, None, None)], "doc int, id int, parent int, v string")
    assert {r.id: r.value for r in graph.inherited(nodes, "v").collect()} == {1: "a", 2: "a", 3: "a", 4: None}
    held, links = graph.copied(spark.createDataFrame([(1, i) for i in (1, 2, 3, 8, 9)], "doc int, id int"), edges, roots)
    assert sorted((r.id, r.new_id) for r in held.collect()) == [(1, 1), (2, 2), (3, 3)] and links.count() == 3


def test_refs():
    assert pdf_pages.references({"a": [Ref(1), {"b": Ref(2)}], "c": Stream({"d": Ref(3)}, b"")}) == [1, 2, 3]
