"""Incremental FASTA/FASTQ parser for bytes that arrive in any pieces."""

from __future__ import annotations

from dataclasses import dataclass


class FormatError(ValueError):
    """Input that is neither FASTA nor FASTQ."""


@dataclass
class Record:
    header: str
    seq: str
    qual: str | None = None


class ChunkParser:
    """push() returns the records completed so far, finish() the last one.

    The first byte that isn't white space tells FASTA (>) from FASTQ (@). Lines end in LF or CRLF,
    the last one in either or nothing. FASTA sequences may span lines and be empty, and blank lines
    are skipped; a FASTQ record is four lines whose sequence and quality are equally long.
    """

    def __init__(self) -> None:
        self.rest: list[bytes] = []  # pieces of a line that has not ended
        self.kind: str | None = None
        self.header: str | None = None
        self.seq: list[str] = []
        self.lines: list[str] = []

    def push(self, data: bytes) -> list[Record]:
        out: list[Record] = []
        if b"\n" not in data:
            self.rest.append(data)
            return out
        *lines, rest = b"".join([*self.rest, data]).split(b"\n")
        self.rest = [rest]
        for line in lines:
            self._line(line.removesuffix(b"\r").decode("utf-8", "replace"), out)
        return out

    def finish(self) -> list[Record]:
        out: list[Record] = []
        if rest := b"".join(self.rest):
            self._line(rest.removesuffix(b"\r").decode("utf-8", "replace"), out)
            self.rest = []
        if self.kind == "fasta" and self.header is not None:
            out.append(Record(self.header, "".join(self.seq)))
            self.header, self.seq = None, []
        if self.lines:
            raise FormatError("the input ends within a FASTQ record")
        return out

    def _line(self, line: str, out: list[Record]) -> None:
        if self.kind is None:
            line = line.lstrip()
            if not line:
                return
            if line[0] not in ">@":
                raise FormatError(f"expected > or @ at the start, found {line[0]!r}")
            self.kind = "fasta" if line[0] == ">" else "fastq"
        if self.kind == "fasta":
            if line.startswith(">"):
                if self.header is not None:
                    out.append(Record(self.header, "".join(self.seq)))
                self.header, self.seq = line[1:], []
            elif line.strip():
                self.seq.append(line.strip())
            return
        if not self.lines and not line.strip():
            return
        self.lines.append(line)
        at = len(self.lines)
        if at == 1 and not line.startswith("@"):
            raise FormatError("a FASTQ header does not start with @")
        if at == 3 and not line.startswith("+"):
            raise FormatError("the third line of a FASTQ record does not start with +")
        if at == 4:
            header, seq, _, qual = self.lines
            if len(seq) != len(qual):
                raise FormatError(f"sequence and quality of {header[1:]!r} differ in length")
            out.append(Record(header[1:], seq, qual))
            self.lines = []
