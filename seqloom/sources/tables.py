"""Configuration tables, checked strictly when they are read: small dimensions of the driver."""

from __future__ import annotations

import csv
import re

from seqloom.plans.layout import Layout


def _rows(path: str) -> list[list[str]]:
    with open(path, newline="") as f:
        return [r for r in csv.reader(f, delimiter="\t") if r]


def _dna(text: str, where: str) -> str:
    if not re.fullmatch("[ACGTacgt]+", text):
        raise ValueError(f"{where}: {text!r} is no DNA sequence")
    return text.upper()


def read_barcodes(path: str, layout: Layout) -> list[tuple[str, str, str]]:
    """(set, id, sequence) from Set, ID, Sequence."""
    header, *rows = _rows(path)
    if header != ["Set", "ID", "Sequence"]:
        raise ValueError(f"{path}: the header must be Set, ID, Sequence")
    out, seen = [], set()
    for s, i, seq in rows:
        if not re.fullmatch("[A-SU-Z]", s):
            raise ValueError(f"{path}: set {s!r} is no barcode symbol")
        if (s, i) in seen:
            raise ValueError(f"{path}: {i} is twice in set {s}")
        if s in layout.symbols and len(seq) != layout.length(s):
            raise ValueError(f"{path}: {i} has {len(seq)} bases, the structure {layout.length(s)}")
        seen.add((s, i))
        out.append((s, i, _dna(seq, path)))
    roots = [seq for s, _, seq in out if layout.symbols and s == layout.symbols[0]]
    if len(set(roots)) != len(roots):
        raise ValueError(f"{path}: first-level sequences must differ")
    return out


def read_samples(path: str, layout: Layout, barcodes: list[tuple[str, str, str]]) -> list[dict[str, str]]:
    """Rows with Sample and a column for each barcode symbol, in alphabetical order."""
    header, *rows = _rows(path)
    if header != ["Sample", *layout.symbols]:
        raise ValueError(f"{path}: the header must be Sample, {', '.join(layout.symbols)}")
    known = {(s, i) for s, i, _ in barcodes}
    out = [dict(zip(header, r)) for r in rows]
    if not out:
        raise ValueError(f"{path}: no samples")
    for r in out:
        for s in layout.symbols:
            if (s, r[s]) not in known:
                raise ValueError(f"{path}: {r['Sample']} has an unknown barcode {r[s]} in {s}")
    for what, values in (("names", [r["Sample"] for r in out]), ("barcode combinations", [tuple(r[s] for s in layout.symbols) for r in out])):
        if len(set(values)) != len(values) or "" in values:
            raise ValueError(f"{path}: sample {what} must differ")
    file_names([r["Sample"] for r in out])
    return out


def file_names(samples: list[str]) -> dict[str, str]:
    """Names that are safe in paths; two that meet, or a reserved one, are an error."""
    out = {s: re.sub(r"[^A-Za-z0-9._-]", "_", s) for s in samples}
    if len(set(out.values())) != len(out) or "unassigned" in out.values():
        raise ValueError("sample names collide with each other or with 'unassigned' in file names")
    return out


def read_technical(path: str, layout: Layout) -> dict[int, str]:
    """mate -> technical bases from Mate, Sequence."""
    header, *rows = _rows(path)
    if header != ["Mate", "Sequence"]:
        raise ValueError(f"{path}: the header must be Mate, Sequence")
    out: dict[int, str] = {}
    for mate, seq in rows:
        m = {"R1": 1, "R2": 2}.get(mate)
        s = next((x for x in layout.structures if x.mate == m), None)
        need = sum(x.end - x.start for x in s.segments if x.symbol == "T") if s else 0
        if m is None or m in out or len(seq) != need:
            raise ValueError(f"{path}: one row for a mate, with its {need} technical bases")
        out[m] = _dna(seq, path)
    return out


def read_adapters(path: str) -> list[tuple[str, str]]:
    """(name, sequence) of a FASTA file."""
    out: list[list[str]] = []
    with open(path) as f:
        for line in map(str.strip, f):
            if line.startswith(">"):
                out.append([line[1:], ""])
            elif line and not out:
                raise ValueError(f"{path}: a sequence before the first name")
            elif line:
                out[-1][1] += line
    return [(n, _dna(s, path)) for n, s in out]


def read_blacklist(path: str) -> list[str]:
    with open(path) as f:
        out = [_dna(x.strip(), path) for x in f if x.strip()]
    if not out or len(set(out)) != len(out):
        raise ValueError(f"{path}: sequences, each once")
    return out
