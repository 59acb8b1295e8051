import pytest

from netloom.sources import matrix_market as mm


def put(tmp_path, text):
    path = tmp_path / "a.mtx"
    path.write_text(text)
    return str(path)


def test_weighted_pattern(spark, tmp_path):
    text = "\n\n%%MatrixMarket weighted-matrix coordinate pattern general\n% about\n3 2 4 3\n1 1\n2 1\n3 2\n1 2\n1\n2\n3\n4\n5\n% end\n"
    m = mm.read(spark, put(tmp_path, text))
    assert (m.meta.object, m.meta.field, m.meta.header, m.meta.tail) == ("W", "P", "% about", "% end")
    assert [(r["i"], r["j"]) for r in m.nz.orderBy("t").collect()] == [(0, 0), (1, 0), (2, 1), (0, 1)]
    assert [r["w"] for r in m.row_weight.orderBy("idx").collect()] == [1, 2, 3]
    assert [r["w"] for r in m.col_weight.orderBy("idx").collect()] == [4, 5]


@pytest.mark.parametrize("extended", [False, True])
def test_distributed_round_trip(spark, tmp_path, extended):
    head = "%%Extended-MatrixMarket distributed-matrix coordinate real general original" if extended else "%%MatrixMarket distributed-matrix coordinate real general"
    starts = "1\n3\n4\n4" if extended else "0\n2\n3\n3"
    m = mm.read(spark, put(tmp_path, f"{head}\n3 3 3 3\n{starts}\n1 1 1.5\n2 2 -2\n3 3 0.1234567890123\n"))
    assert [r["part"] for r in m.nz.orderBy("t").collect()] == [0, 0, 1]
    mm.write(m, str(tmp_path / "out"))
    again = mm.read(spark, str(tmp_path / "out"))
    assert again.meta == m.meta and again.nz.orderBy("t").collect() == m.nz.orderBy("t").collect()


def test_complex_entries(spark, tmp_path):
    m = mm.read(spark, put(tmp_path, "%%MatrixMarket matrix coordinate complex hermitian\n2 2 2\n1 1 1.0 0\n2 1 1.0 1.0\n"))
    assert m.nz.where("im = 1").count() == 1


@pytest.mark.parametrize(
    ("body", "condition", "found"),
    [
        ("weighted-matrix coordinate real general\n2 2 2 3\n1 1 -1.0\n2 1 2.5\n1\n2\n3\n4", "re > 0", 1),
        ("weighted-matrix coordinate pattern general\n2 2 2 3\n1 1\n2 1\n1\n2\n3\n4", "j = 0", 2),
        ("matrix coordinate complex general\n2 2 2\n1 1 1 2\n2 1 3 4", "im > 2", 1),
    ],
)
def test_filters_reach_entries_only(spark, tmp_path, body, condition, found):
    assert mm.read(spark, put(tmp_path, f"%%MatrixMarket {body}\n")).nz.where(condition).count() == found


def test_long_comments_are_read_whole(spark, tmp_path):
    head, tail = "\n".join(f"% {k}" for k in range(12_000)), "\n".join(f"% end {k}" for k in range(1_500))
    m = mm.read(spark, put(tmp_path, f"%%MatrixMarket matrix coordinate pattern general\n{head}\n1 1 1\n1 1\n{tail}\n"))
    assert m.meta.header == head and m.meta.tail == tail and m.nz.count() == 1


@pytest.mark.parametrize(
    "text",
    ["%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1.0\n", "%%MatrixMarket matrix coordinate real symmetric\n2 2 1\n1 2 1.0\n", "%%MatrixMarket matrix coordinate real general\n0 2 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n"],
)
def test_wrong_files_raise(spark, tmp_path, text):
    with pytest.raises(ValueError):
        mm.read(spark, put(tmp_path, text))


def test_vectors(spark, tmp_path):
    length, parts, owner = mm.read_vector(spark, put(tmp_path, "% owners\n3 2\n1 1\n2 2\n3 1\n"))
    assert (length, parts) == (3, 2) and [tuple(r) for r in owner.orderBy("idx").collect()] == [(0, 0), (1, 1), (2, 0)]
    assert [r["line"] for r in mm.vector_lines(owner, 3, 2).orderBy("pos").collect()] == ["3 2", "1 1", "2 2", "3 1"]
