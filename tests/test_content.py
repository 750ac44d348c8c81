import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import content as C
from palimpsest.functions.content import Fill
from palimpsest.functions.images import covered_pixels
from palimpsest.operators.boxes import merge_near
from palimpsest.sources.pdf_syntax import Name, SyntaxFault, encoded, number_text, operations


def test_placements():
    assert C.placements(b"30 0 0 40 7 9 cm /Pic Do")[0][2] == (7, 9, 37, 49)
    assert C.placements(b"") == []
    two = C.placements(b"5 0 0 5 0 0 cm /A Do 1 0 0 1 3 4 cm /B Do")
    assert [name for name, _, _ in two] == ["A", "B"] and two[1][1] == (5, 0, 0, 5, 3, 4)
    assert C.placements(b"5 0 0 5 0 0 cm 1 0 0 1 3 4 cm /B Do", parity=False)[0][1] == (5, 0, 0, 5, 15, 20)
    assert C.placements(b"q 8 0 0 6 1 1 cm Q Q Q /A Do")[0][1] == C.IDENTITY
    nested = C.placements(b"/Z Do q 4 0 0 4 1 2 cm q 9 0 0 9 0 0 cm /X Do Q /Y Do Q /Z Do")
    assert [p[1] for p in nested] == [C.IDENTITY, (36, 0, 0, 36, 9, 18), (4, 0, 0, 4, 1, 2), C.IDENTITY]


@pytest.mark.parametrize(
    ("stream", "count"),
    [
        (b"1 1 1 rg 0 0 10 10 re f", 1), (b"1 g 0 0 10 10 re F", 1), (b"0 0 0 0 k 0 0 10 10 re f*", 1), (b"1 1 1 scn 0 0 10 10 re f", 1),
        (b"0.5 g 0 0 10 10 re f", 0), (b"0 0 10 10 re f", 0), (b"1 g 0 0 10 10 re S", 0), (b"1 g 0 0 10 10 re 1 1 m f", 0), (b"1 g 0 0 10 10 re W f", 0),
        (b"1 g 0 0 1 1 re 2 2 1 1 re f", 2), (b"q 1 g Q 0 0 1 1 re f", 0),
    ],
)
def test_white_rects(stream, count):
    assert len(C.white_rects(stream)) == count


def test_white_rect_box():
    assert C.white_rects(b"1 g q 4 0 0 5 6 7 cm 1 2 3 4 re f Q") == [(10, 17, 22, 37)]


@pytest.mark.parametrize(
    ("stream", "kept"),
    [(b"q BT /F1 12 Tf (a) Tj ET Q", "q Q"), (b"BT BT (a) Tj ET (b) Tj ET q", "q"), (b"ET q BT ET Q", "q Q"), (b"", ""), (b"BT ET BT (x) Tj ET /Im Do", "/Im Do")],
)
def test_strip(stream, kept):
    assert C.strip_text(stream).decode().split() == kept.split()
    assert C.strip_text(C.strip_text(stream)) == C.strip_text(stream)


def test_text_positions():
    at = lambda s: [c["text_matrix"][4:] for c in C.text_commands(s)]
    assert at(b"BT /G 9 Tf 1 0 0 1 31 410 Tm 4 6 Td (a) Tj 1 -1 Td (b) Tj ET") == [(35, 416), (36, 415)]
    assert [y for _, y in at(b"BT /G 9 Tf 0 -11 TD (a) Tj T* (b) Tj T* (c) Tj ET")] == [-11, -22, -33]
    assert [y for _, y in at(b"BT /G 9 Tf 20 TL 5 300 Td (a) Tj T* (b) Tj (c) ' ET")] == [300, 280, 260]
    (c,) = C.text_commands(b"3 0 0 4 5 6 cm BT /G 9 Tf (a) Tj ET")
    assert (c["font"], c["size"], c["ctm"]) == ("G", 9, (3, 0, 0, 4, 5, 6))
    assert C.text_commands(b"BT (a) Tj ET")[0]["font"] == ""


def test_codes():
    assert C.char_codes(bytes.fromhex("6f225b57"), True) == [0x6F22, 0x5B57]
    assert C.char_codes(b"xy\x01", True) == [0x7879] and C.char_codes(b"xy", False) == [0x78, 0x79]
    assert C.tj_entries([b"A", -120, Name("x"), b"B"], False) == [[65], -120.0, [66]]


def test_split_operations():
    commands, kept = C.split_operations(b"q BT /F1 9 Tf (A) Tj ET 1 g Q")
    assert [c["codes"] for c in commands] == [[65]] and [o for o, _ in kept] == ["q", "g", "Q"]


def test_outlines_need_fonts():
    with pytest.raises(KeyError):
        C.outlines(b"BT /None 8 Tf (a) Tj ET", {})
    assert C.outlines(b"q Q", {}) == b"q\nQ"


class Box:
    two_byte, units = False, 1000

    def outline(self, code):
        return [("M", 0.0, 0.0), ("Q", 500.0, 1000.0, 1000.0, 0.0), ("Z",)]

    def width(self, code):
        return 500.0


def test_outline_paths():
    out = C.outlines(b"1 0 0 rg BT /F 12 Tf 2 Tw (a b) Tj ET", {"F": Box()}).decode()
    assert out.count("1 0 0 rg\n0 0 m") == 1 and out.count("h\nf\nQ") == 3
    # the quadratic curve as a cubic, and the second glyph 6 to the right
    assert "4 8 8 8 12 0 c" in out and "\n6 0 m" in out and "\n14 0 m" in out
    assert "0 g" in C.outlines(b"1 0 0 rg BT /F 12 Tf (a) Tj ET", {"F": Box()}, force_bw=True).decode()
    assert "\n-2.4 0 m" in C.outlines(b"BT /F 12 Tf [200 (a)] TJ ET", {"F": Box()}).decode()


def test_colors():
    assert Fill((0.0, 0.0, 0.0, 0.0)).white and Fill((1.0,)).white and not Fill((0.99,)).white
    assert Fill((1.0, 0.0, 0.0)).luminance == pytest.approx(0.299)
    assert Fill((0.0, 0.0, 0.0, 0.2)).operator(True) == "1 g"


@pytest.mark.parametrize(("v", "text"), [(1.0, "1"), (0.12345, "0.1235"), (-0.00001, "0"), (100.5, "100.5"), (-2.25, "-2.25")])
def test_numbers(v, text):
    assert number_text(v) == text


def test_operations():
    data = b"q % note\n[(a\\)b) -3.5 <4142>] TJ BI /W 1 /H 1 ID \x00 EI /A#20B gs"
    ops = operations(data)
    assert ops[1] == ("TJ", [[b"a)b", -3.5, b"AB"]]) and ops[2][0] == "BI" and ops[3][1] == ["A B"]
    assert operations(encoded(ops)) == ops
    for bad in (b"(a", b"1 2", b"<< /a 1"):
        with pytest.raises((SyntaxFault, EOFError)):
            operations(bad)


def test_covered_pixels():
    assert covered_pixels((10, 10, 50, 30), (10, 10, 50, 30), 80, 60) == (0, 0, 80, 60)
    assert covered_pixels((20, 10, 30, 15), (10, 10, 50, 30), 40, 20) == (10, 15, 10, 5)
    assert covered_pixels((60, 0, 70, 9), (10, 10, 50, 30), 40, 20) is None


_box = st.tuples(*[st.integers(0, 60)] * 2, *[st.integers(1, 15)] * 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(_box, max_size=12), st.integers(0, 6), st.randoms())
def test_merge_ignores_order(boxes, distance, rng):
    shuffled = boxes[:]
    rng.shuffle(shuffled)
    found = merge_near(boxes, distance)
    assert found == merge_near(shuffled, distance)
    assert found == merge_near(found, distance)


def test_merge_distance():
    boxes = [(0, 0, 4, 8), (7, 2, 4, 8)]
    assert merge_near(boxes, 3) == [(0, 0, 11, 10)] and len(merge_near(boxes, 2)) == 2


def test_merge_against_pairs():
    """Against joining any two near boxes, one pair at a time."""
    rng = random.Random(4)
    for _ in range(60):
        boxes = [(rng.randrange(90), rng.randrange(90), rng.randrange(1, 9), rng.randrange(1, 30)) for _ in range(rng.randrange(30))]
        want = [(x, y, x + w, y + h) for x, y, w, h in boxes]
        near = lambda a, b: a[0] - b[2] <= 4 and b[0] - a[2] <= 4 and a[1] - b[3] <= 4 and b[1] - a[3] <= 4
        while pair := next(((a, b) for a, b in itertools.combinations(want, 2) if near(a, b)), None):
            a, b = pair
            want.remove(a)
            want.remove(b)
            want.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))
        assert merge_near(boxes, 4) == sorted((a, b, c - a, d - b) for a, b, c, d in want)


def test_merge_many():
    boxes = [(6 * (i % 300), 6 * (i // 300), 3, 3) for i in range(60_000)]
    assert merge_near(boxes, 2) == sorted(boxes) and merge_near(boxes[:9000], 3) == [(0, 0, 1797, 177)]
