import pytest

from tensorframe.sources.text import banner_of, parsable, read_matrix_market, read_tns, write_matrix_market, write_tns
from tests.test_algebra import cells, make


def test_matrix_market(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    head = "%%MatrixMarket matrix coordinate real "
    t = read_matrix_market(spark, put("g.mtx", head + "general\n% note\n3 3 3\n1 2 4.5\n3 3 3\n1 2 0.5\n"))
    assert cells(t) == {(0, 1): 5.0, (2, 2): 3.0} and t.shape == {"i": 3, "j": 3}
    assert cells(read_matrix_market(spark, put("s.mtx", head + "symmetric\n2 2 2\n1 1 1\n2 1 3\n"))) == {(0, 0): 1.0, (1, 0): 3.0, (0, 1): 3.0}
    assert cells(read_matrix_market(spark, put("k.mtx", head + "skew-symmetric\n2 2 1\n2 1 3\n"))) == {(1, 0): 3.0, (0, 1): -3.0}
    write_matrix_market(t, str(tmp_path / "out"))
    assert cells(read_matrix_market(spark, str(tmp_path / "out"))) == cells(t)
    for bad in ("2 2 2\n1 1 1\n", "2 2 1\n1 1 1\n2 2 1\n", "2 2 1\n3 1 1\n", "2 2 1\n1 0 1\n", "2 2 1 1\n1 1 1\n", ""):
        with pytest.raises(Exception, match="declares|outside|extents"):
            read_matrix_market(spark, put("bad.mtx", head + "general\n" + bad)).df.collect()
    assert not parsable(spark, put("c.mtx", "%%MatrixMarket matrix coordinate complex general\n1 1 0\n"))
    for bad in ("nothing", "%%MatrixMarket matrix array real general", head + "hermitian"):
        with pytest.raises(ValueError):
            banner_of(bad)


def test_tns(spark, tmp_path):
    (tmp_path / "a.tns").write_text("# note\n1 2 3 1.5\n1 2 3 1\n2 1 1 4\n\n")
    t = read_tns(spark, str(tmp_path / "a.tns"), ("i", "j", "k"))
    assert cells(t) == {(0, 1, 2): 2.5, (1, 0, 0): 4.0}
    assert cells(read_tns(spark, str(tmp_path / "a.tns"), ("i", "j", "k"), mode_order=(2, 0, 1))) == {(2, 0, 1): 2.5, (0, 1, 0): 4.0}
    write_tns(t, str(tmp_path / "b"))
    assert cells(read_tns(spark, str(tmp_path / "b"), ("i", "j", "k"))) == cells(t)
    assert cells(read_tns(spark, str(tmp_path / "a.tns"), ("i", "j", "k"), dtype="float"))[1, 0, 0] == 4.0
    assert make is not None
