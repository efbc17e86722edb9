"""Worker-side helper: the first part of an mzML file, read without loading the rest."""

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs

from ionframe.sources import blocks

_HEAD_END = re.compile(rb"<run\b[^>]*/>|<spectrumList\b|<chromatogramList\b|</run\s*>")
_ENCODING = re.compile(rb"<\?xml[^>]*encoding=[\"']([^\"']+)")


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    uri = quote(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)), safe="/:@")
    return fs.FileSystem.from_uri(uri)


def encoding_of(start: bytes) -> str:
    """The encoding that a file's first bytes declare."""
    found = _ENCODING.match(start)
    return found.group(1).decode() if found else "utf-8"


def head_of_file(path: str) -> str | None:
    """The text of one file before its spectra and chromatograms, closed so that it is well-formed; null
    where that does not come."""
    filesystem, inner = locate(path)
    data = b""
    with filesystem.open_input_file(inner) as file:
        stream = blocks.Blocks(file) if blocks.is_blocked(path) else file
        while block := stream.read(1 << 16):
            data += block
            if end := _HEAD_END.search(data):
                empty_run = end.group().endswith(b"/>")
                head = data[: end.end() if empty_run else end.start()]
                text = head.decode(encoding_of(data))
                start = re.search(r"<mzML\b", text)
                return text[start.start() :] + ("</mzML>" if empty_run else "</run></mzML>") if start else None
    return None


def read_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"run_id": batch["run_id"], "xml": [head_of_file(p) for p in batch["path"]]})
