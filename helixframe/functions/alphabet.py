"""Residue alphabets. The IUPAC nucleotide codes, their complements, and the genetic code."""

#: Nucleotides as bits of A=1, T=2, C=4, G=8; two codes match if they share a bit.
IUPAC = {"A": 1, "T": 2, "U": 2, "C": 4, "G": 8, "M": 5, "R": 9, "W": 3, "S": 12, "Y": 6, "K": 10, "V": 13, "H": 7, "D": 11, "B": 14, "N": 15}
#: Codes and their complements, for DNA; RNA has U for T.
COMPLEMENT_FROM, COMPLEMENT_DNA = "ATUCGMRWSYKVHDBN", "TAAGCKYWSRMBDHVN"
#: The bacterial code (table 11): amino acids of the codons in TCAG order, and the codons that may start a protein.
CODE_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ("TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG")

CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(CODE_ORDER) for j, b in enumerate(CODE_ORDER) for k, c in enumerate(CODE_ORDER)}


def matching(code: str) -> str:
    """All codes, in both cases, that match a code."""
    bits = IUPAC[code.upper()]
    return "".join(c + c.lower() for c, b in IUPAC.items() if b & bits)


def as_regex(pattern: str) -> str:
    """A regular expression for the sequences that a pattern of codes matches; other characters stand for themselves."""
    import re

    return "".join(f"[{matching(c)}]" if c.upper() in IUPAC else re.escape(c) for c in pattern)


def reverse_complement(pattern: str) -> str:
    """The reverse complement of a DNA pattern."""
    return pattern[::-1].translate(str.maketrans(COMPLEMENT_FROM + COMPLEMENT_FROM.lower(), COMPLEMENT_DNA + COMPLEMENT_DNA.lower()))
