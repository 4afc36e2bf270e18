"""File formats by name."""

from __future__ import annotations

from merscope.sources.spread import GZIP

# The file name endings of each format; each may add .gz.
SUFFIXES = {"fasta": (".fa", ".fasta"), "fastq": (".fq", ".fastq")}


def file_format(path: str) -> str:
    """``fasta`` or ``fastq``, from the (case-sensitive) end of the name."""
    name = path.removesuffix(GZIP)
    for kind, endings in SUFFIXES.items():
        if name.endswith(endings):
            return kind
    raise ValueError(f"cannot tell the format of {path} from its name")
