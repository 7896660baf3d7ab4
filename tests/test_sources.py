"""Character maps, page tiers, image thresholds and line predicates."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators import vision
from quire.sources import pages
from quire.sources.tables import file_kind

CMAP = "1 beginbfchar <F643> <0031> endbfchar 1 beginbfrange <0041> <0043> <0061> endbfrange"


def test_character_map():
    assert pages.character_map(CMAP) == {0xF643: "1", 0x41: "a", 0x42: "b", 0x43: "c"}


def test_character_maps_of_files(spark):
    raw = b"%PDF-1.4\nstream\n" + zlib.compress(CMAP.encode()) + b"\nendstream\nstream\nplain\nendstream"
    files = spark.createDataFrame([("a", bytearray(raw)), ("b", None), ("c", bytearray(b"none"))], "path string, content binary")
    got = pages.character_maps(files).collect()
    assert {(r["path"], r["code"], r["to"]) for r in got} == {("a", 0xF643, "1"), ("a", 0x41, "a"), ("a", 0x42, "b"), ("a", 0x43, "c")}


@pytest.mark.parametrize("raw, kind", [(b"%PDF-1.4", "pdf"), (b"\xff\xd8\xff", "jpeg"), (b"\x89PNG", "png"), (b"GIF89a", "gif"), (b"RIFF0000WEBP", "webp"), (b"", None)])
def test_file_kind(spark, raw, kind):
    assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(file_kind(F.col("c")).alias("k")).first()["k"] == kind


@pytest.mark.parametrize("n, mb, tier", [(10, 1, (8, 6)), (120, 1, (3, 2)), (401, 1, (2, 1)), (10, 48, (1, 1))])
def test_page_workers(spark, n, mb, tier):
    assert tuple(spark.range(1).select(pages.page_workers(F.lit(n), F.lit(mb << 20)).alias("t")).first()["t"]) == tier


def test_threshold_parts_ink_from_paper():
    grey = np.array([10] * 50 + [20] * 50 + [200] * 60 + [220] * 40)
    assert 20 <= vision.threshold(grey) < 200 and vision.threshold(np.full(9, 7)) == vision.FLAT
    page = np.zeros((4, 4, 3), np.uint8)
    page[0, 0] = 255
    assert vision.binary(page)[0, 0] == 0 and vision.binary(page)[3, 3] == 255


@pytest.mark.parametrize("read, number", [("CHAPTER 12 x", 12), ("7 99", None), ("no", None), (None, None)])
def test_chapter_number(spark, read, number):
    assert spark.createDataFrame([(read,)], "r string").select(vision.chapter_number(F.col("r")).alias("n")).first()["n"] == number


def test_predicates(spark):
    texts = {"dangling": "The End of", "short_dialogue": "“Go.”", "attribution": "he said quietly.", "salutation": "Dear Sir,", "sign_off": "Yours truly,", "all_caps": "THE FOX", "structural_heading": "Chapter IV", "author_line": "by Ann Author"}
    for name, text in texts.items():
        other = spark.createDataFrame([(text,), ("It was a plain line of prose, with words.",)], "t string").select(getattr(P, name)(F.col("t")).alias("r")).collect()
        assert [r["r"] for r in other] == [True, False], name


def test_character_maps_of_ligatures_lists_and_long_ranges():
    from quire.sources.pages import character_map

    got = character_map("beginbfchar <01> <00660066> <02> <D83DDE00> endbfchar beginbfrange <10> <12> <00660066> <20> <21> [<0041> <00420043>] <30> <31> <D83DDE00> endbfrange")
    assert (got[0x10], got[0x12], got[0x21], got[0x30], got[0x31]) == ("ff", "fh", "BC", "\U0001f600", "\U0001f601")
    got = character_map("beginbfrange <000000> <02FFFF> <0000> endbfrange")
    assert len(got) > 190_000 and got[0x2FFFF] == chr(0x2FFFF)
    with pytest.raises(ValueError):
        character_map("beginbfrange <00000000> <FFFFFFFF> <0000> endbfrange")
