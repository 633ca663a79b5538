"""SAM text in and out: headers, ranges, tags and what breaks the contract."""

import pytest

from seqloom.sources import sam_text

HD = "@HD\tVN:1.6\tSO:queryname\n"


def line(name, flag, seq="ACGT", *tags):
    return "\t".join([name, str(flag), "*", "0", "0", "*", "*", "0", "0", seq, "I" * len(seq), *tags]) + "\n"


def test_headers_and_program_chain(tmp_path):
    (tmp_path / "x.sam").write_text(HD + "@PG\tID:a\tPN:a\n@PG\tID:b\tPN:b\tPP:a\n" + line("q", 77))
    header = sam_text.read_header(str(tmp_path / "x.sam"))
    assert len(header) == 3
    one = sam_text.with_program(header, "trim x")
    assert one[-1] == "@PG\tID:seqloom\tPN:seqloom\tPP:b\tCL:trim x"
    assert sam_text.with_program(one)[-1] == "@PG\tID:seqloom.1\tPN:seqloom\tPP:seqloom" and sam_text.with_program([]) == ["@PG\tID:seqloom\tPN:seqloom"]
    for text in ("@HD\tVN:1.6\tSO:queryname", "@HD\tVN:1.6\tSO:unsorted\tGO:query"):
        sam_text.check_header([text], True)
    for bad in ([], ["@HD\tVN:1.6\tSO:coordinate"], ["@SQ\tSN:x"]):
        sam_text.check_header(bad, False)
        with pytest.raises(ValueError, match="GO:query"):
            sam_text.check_header(bad, True)


def test_pairs_from_ranges(spark, tmp_path):
    text = HD + "".join(line(f"q{i}", f, "ACGTACGT"[: 4 + i % 4], f"XX:Z:t:{i}") for i in range(200) for f in ((77, 141) if i % 2 else (141, 77)))
    (tmp_path / "x.sam").write_text(text)
    for size in (400, 5000):
        got = sam_text.read_checked(spark, str(tmp_path / "x.sam"), True, size).collect()
        assert {(r.qname, r.read_idx, r.r1_first) for r in got} == {(f"q{i}", 2 * i, bool(i % 2)) for i in range(200)}
    tags = sam_text.read_sam(spark, str(tmp_path / "x.sam"), True, 999).orderBy("read_idx").select("tags").collect()
    assert [r.tags["XX"].value for r in tags[::2]] == [f"t:{i}" for i in range(200)]
    sam_text.write_sam(sam_text.read_sam(spark, str(tmp_path / "x.sam"), True), str(tmp_path / "o"), "y.sam", sam_text.read_header(str(tmp_path / "x.sam")))
    lines = (tmp_path / "o/y.sam").read_text().splitlines()
    assert lines[2:] == text.splitlines()[1:] and lines[1].startswith("@PG")


@pytest.mark.parametrize("broken,what", [("q\t4\n", "fewer than 11"), (line("q", "x"), "flag is no number"), (line("q", 4, "ACGT", "bad"), "a tag is broken"), (line("q", 4, "ACGT", "NM:i:1", "NM:i:2"), "a tag is broken"), (line("q", 260), "secondary"), (line("q", 0), "aligned")])
def test_broken_records_are_named(spark, tmp_path, broken, what):
    (tmp_path / "x.sam").write_text(line("fine", 4) + broken)
    with pytest.raises(Exception, match=what):
        sam_text.read_checked(spark, str(tmp_path / "x.sam"), False).collect()
    (tmp_path / "empty.sam").write_text(HD)
    assert sam_text.read_sam(spark, str(tmp_path / "empty.sam"), True).count() == 0
