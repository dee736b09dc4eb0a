"""Parameters and metadata."""

from __future__ import annotations

from dataclasses import asdict, dataclass

#: File types by name; "any" accepts all of them, a list file is none of them.
FILE_TYPES = ("text", "cortex", "kmers", "fasta", "fastq", "mfasta", "mfastq")
#: Names by which a type may be asked for.
TYPE_NAMES = {"any": "any", "*": "any", "txt": "text", "text": "text", "ctx": "cortex", "cortex": "cortex", "kmers": "kmers", "fasta": "fasta", "fastq": "fastq", "mfasta": "mfasta", "mfastq": "mfastq", "list": "list"}


def file_type_named(name: str) -> str:
    found = TYPE_NAMES.get(name.lower())
    if found is None:
        raise ValueError(f"unknown file type {name!r}")
    return found


@dataclass(frozen=True)
class ClassicParams:
    """One signature size for all documents; 0 derives it from the largest document."""

    term_size: int = 31
    canonicalize: bool = True
    num_hashes: int = 1
    false_positive_rate: float = 0.3
    signature_size: int = 0
    family: str = "xxh64"


@dataclass(frozen=True)
class CompactParams:
    """Pages of 8 * page_size documents of like size; page_size 0 derives it from their number."""

    term_size: int = 31
    canonicalize: bool = True
    num_hashes: int = 1
    false_positive_rate: float = 0.3
    page_size: int = 0
    family: str = "xxh64"


@dataclass(frozen=True)
class Meta:
    layout: str
    term_size: int
    canonicalize: bool
    num_hashes: int
    family: str
    num_docs: int
    page_docs: int

    def row(self) -> dict:
        return asdict(self)
