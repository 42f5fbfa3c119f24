"""Read structures: where barcodes, UMI, poly-T and cDNA lie in each read of a tuple, compiled to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Read structures by method (fixed values): read number -> field -> 1-based inclusive positions; an empty list is the
#: whole read; NAME_value lists the values that a barcode may take.
STRUCTURES: dict[str, dict] = {
    "10X": {1: {"CB1": [1, 16], "UMI": [17, 26]}, 2: {"cDNA": []}},
    "10X-polyT": {1: {"CB1": [1, 16], "UMI": [17, 26], "polyT": [27, 31]}, 2: {"cDNA": []}},
    "InDrop": {1: {"CB1": [1, 8]}, 2: {"CB2": [1, 8], "CB2_value": ["CATAACTG", "GGAGGTAA"]}, 3: {"cDNA": []}, 4: {"CB3": [1, 8], "UMI": [9, 14]}},
    "InDrop-polyT": {1: {"CB1": [1, 8]}, 2: {"CB2": [1, 8], "CB2_value": ["CATAACTG", "GGAGGTAA"]}, 3: {"cDNA": []}, 4: {"CB3": [1, 8], "UMI": [9, 14], "polyT": [15, 19]}},
    "Drop-seq": {1: {"CB1": [1, 12], "UMI": [13, 20]}, 2: {"cDNA": []}},
    "Drop-seq-polyT": {1: {"CB1": [1, 12], "UMI": [13, 20], "polyT": [21, 25]}, 2: {"cDNA": []}},
    "Seq-Well": {1: {"CB1": [1, 12], "UMI": [13, 20]}, 2: {"cDNA": []}},
    "Seq-Well-polyT": {1: {"CB1": [1, 12], "UMI": [13, 20], "polyT": [21, 25]}, 2: {"cDNA": []}},
    "CEL-Seq2": {1: {"UMI": [1, 6], "CB1": [7, 12]}, 2: {"cDNA": []}},
    "CEL-Seq2-polyT": {1: {"UMI": [1, 6], "CB1": [7, 12], "polyT": [13, 17]}, 2: {"cDNA": []}},
    "sci-RNA-seq": {1: {"CB1": [1, 10], "UMI": [17, 24], "CB2": [25, 34]}, 2: {"cDNA": []}},
    "sci-RNA-seq-polyT": {1: {"UMI": [1, 10], "CB1": [17, 24], "CB2": [25, 34], "polyT": [35, 39]}, 2: {"cDNA": []}},
    "SPLiT-seq": {1: {"cDNA": []}, 2: {"UMI": [1, 10], "CB3": [11, 18], "CB2": [49, 56], "CB1": [87, 94]}},
}


@dataclass(frozen=True)
class Template:
    """A compiled read structure. Expressions are over columns seqK and qualK of read K."""

    n_reads: int
    barcodes: dict[str, Column]
    umi: Column
    umi_length: int
    poly_t: Column | None
    matches: Column
    cdna: int
    values: dict[str, list[str]]

    @property
    def cell_barcode(self) -> Column:
        """The components in order of their number, joined with -."""
        return F.concat_ws("-", *self.barcodes.values())


def read_config(config: dict, method: str) -> dict[int, dict]:
    """One method of a parsed YAML configuration: {num_read: n, read1: {...}, ...}."""
    if method not in config:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(config)}")
    entry = config[method]
    reads = {int(k.removeprefix("read")): v for k, v in entry.items() if re.fullmatch(r"read\d+", str(k))}
    if int(entry["num_read"]) != len(reads):
        raise ValueError(f"{method}: num_read is {entry['num_read']}, but {len(reads)} reads are described")
    return reads


def load_config(path: str, method: str) -> dict[int, dict]:
    """One method of a YAML file."""
    import yaml

    with open(path) as f:
        return read_config(yaml.safe_load(f), method)


def compile_template(structure: dict[int, dict], n_files: int | None = None) -> Template:
    """Positions to expressions. A read fits if it is long enough, its quality too, and gaps and tail are over ACGTN."""
    if n_files is not None and n_files != len(structure):
        raise ValueError(f"the structure has {len(structure)} reads, but {n_files} files are given")
    barcodes: dict[str, Column] = {}
    values: dict[str, list[str]] = {}
    umis: list[tuple[Column, int]] = []
    poly_t, cdna, conditions = None, None, []
    for k, fields in sorted(structure.items()):
        seq, qual = F.col(f"seq{k}"), F.col(f"qual{k}")
        if any(name.startswith("cDNA") for name in fields):
            cdna = k
            continue
        placed = sorted((pos[0], pos[1], name) for name, pos in fields.items() if not name.endswith("_value"))
        at = 1
        for start, end, name in placed:
            if start < at:
                raise ValueError(f"read {k}: {name} overlaps the field before it")
            if start > at:
                conditions.append(F.substring(seq, at, start - at).rlike("^[ACGTN]*$"))
            cut = F.substring(seq, start, end - start + 1)
            if name.startswith("CB"):
                barcodes[name] = cut
                if f"{name}_value" in fields:
                    values[name] = list(fields[f"{name}_value"])
            elif name.startswith("UMI"):
                umis.append((cut, end - start + 1))
            else:
                poly_t = cut
            at = end + 1
        conditions += [F.length(seq) >= at - 1, F.length(qual) >= at - 1, F.substring(seq, F.lit(at), F.length(seq)).rlike("^[ACGTN]*$")]
    if len(umis) != 1:
        raise ValueError(f"exactly one UMI is needed; the structure has {len(umis)}")
    if cdna is None:
        raise ValueError("no read is marked cDNA")
    ordered = dict(sorted(barcodes.items(), key=lambda x: int(re.sub(r"\D", "", x[0]) or 0)))
    return Template(len(structure), ordered, umis[0][0], umis[0][1], poly_t, reduce(lambda a, b: a & b, conditions, F.lit(True)), cdna, values)
