"""Page files: character maps of fonts, and the tiers by which pages are read in parallel."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = re.compile(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>")
_RANGE = re.compile(r"<\s*([0-9A-Fa-f]+)\s*>\s*<\s*([0-9A-Fa-f]+)\s*>\s*(?:<\s*([0-9A-Fa-f]+)\s*>|\[([^\]]*)\])")
#: Codes have at most four bytes; a range that is longer than Unicode can't be meant.
_MOST = 0x110000


def _units(to: str) -> bytes:
    return bytes.fromhex(to.zfill(-(-len(to) // 4) * 4))


def character_map(text: str) -> dict[int, str]:
    """Source code to text, from the pairs and ranges of a character map.

    Targets are UTF-16, of one or more characters. A range counts up the last unit of its target, or has a list of targets.
    A range of more codes than Unicode has is an error of the file and raises ValueError.
    """
    out: dict[int, str] = {}
    for block in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
        for code, to in _PAIR.findall(block):
            out[int(code, 16)] = _units(to).decode("utf-16-be", "ignore")
    for block in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
        for lo, hi, to, listed in _RANGE.findall(block):
            lo, hi = int(lo, 16), int(hi, 16)
            if hi - lo >= _MOST:
                raise ValueError(f"range of {hi - lo + 1} codes in a character map")
            if not to:
                for k, one in enumerate(re.findall(r"<\s*([0-9A-Fa-f]+)\s*>", listed)[: hi - lo + 1]):
                    out[lo + k] = _units(one).decode("utf-16-be", "ignore")
                continue
            held = _units(to)
            try:
                text_, last = held.decode("utf-16-be"), None
                last = ord(text_[-1])
            except (UnicodeDecodeError, IndexError):
                continue  # half a character can't be counted up
            for k in range(min(hi - lo, 0x10FFFF - last) + 1):
                if not 0xD800 <= last + k < 0xE000:
                    out[lo + k] = text_[:-1] + chr(last + k)
    return out


def streams(raw: bytes) -> Iterator[bytes]:
    """The streams of a page file, inflated where they are deflated."""
    for found in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        try:
            yield zlib.decompress(found[1])
        except zlib.error:
            yield found[1]


def character_maps(files: DataFrame) -> DataFrame:
    """(path, code, to) from (path, content): the character maps of each file. Maps can be within deflated streams, so each
    stream is inflated; those without the word for a map are not parsed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for s in streams(bytes(content)):
                    if b"beginbf" in s:
                        rows += [(path, code, to) for code, to in character_map(s.decode("latin-1")).items()]
            yield pd.DataFrame(rows, columns=["path", "code", "to"])

    return files.filter(F.col("content").isNotNull()).select("path", "content").mapInPandas(read, "path string, code long, to string")


def page_workers(pages: Column, size: Column) -> Column:
    """Fixed values of tiers. struct(text, image): page readers by the tier of a file's pages and bytes."""
    mb = size / (1 << 20)
    tier = lambda a, b: F.struct(F.lit(a).alias("text"), F.lit(b).alias("image"))
    return F.when((pages > 900) | (mb >= 48), tier(1, 1)).when((pages > 400) | (mb >= 12), tier(2, 1)).when(pages >= 120, tier(3, 2)).otherwise(tier(8, 6))


def raw_length_fits(width: Column, height: Column, channels: Column, content: Column) -> Column:
    """Whether raw pixels have the length that their size and kind ask for."""
    return F.octet_length(content) == width * height * channels
