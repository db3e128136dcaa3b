"""Native column builders: encoding, reduced alphabet, reverse complement, translation, coordinates, contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.alphabet import CODONS, DNA, PROTEIN, REDUCED, Alphabet, ReducedAlphabet

#: One character for each reduced class, so that a class string is as long as its sequence.
CLASS_LETTERS = "0123456789abcdefghijklmnop"


def normalize(seq: Column, alphabet: Alphabet = PROTEIN) -> Column:
    """Upper case; letters outside the alphabet become the unknown letter."""
    return F.regexp_replace(F.upper(seq), f"[^{alphabet.letters.replace('*', chr(92) + '*')}]", alphabet.unknown)


def encode(seq: Column, alphabet: Alphabet = PROTEIN) -> Column:
    """array<int> of letter codes."""
    letters = F.split(normalize(seq, alphabet), "")
    return F.when(F.length(seq) > 0, F.transform(letters, lambda c: F.call_function("instr", F.lit(alphabet.letters), c) - 1)).otherwise(F.array().cast("array<int>"))


def decode(codes: Column, alphabet: Alphabet = PROTEIN) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substr(F.lit(alphabet.letters), c + 1, F.lit(1))), "")


def is_unknown(letter: Column, alphabet: Alphabet = PROTEIN) -> Column:
    """The letter is encoded as unknown without being the unknown letter."""
    return F.call_function("instr", F.lit(alphabet.letters), F.upper(letter)) == 0


def reduce(seq: Column, reduced: ReducedAlphabet = REDUCED) -> Column:
    """Class string: a CLASS_LETTERS character for each residue."""
    letters = reduced.alphabet.letters
    return F.translate(normalize(seq, reduced.alphabet), letters, "".join(CLASS_LETTERS[reduced.code_of[x]] for x in letters))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(normalize(seq, DNA)), "ACGTN", "TGCAN")


def translate_frame(dna: Column, offset: int) -> Column:
    """Amino acids of one forward frame; a codon with an unknown letter gives X, stops give *.

    The string is cut into codons once, so the work is linear in its length.
    """
    table = F.create_map(*[x for k, v in CODONS.items() for x in (F.lit(k), F.lit(v))])
    codons = F.regexp_extract_all(F.substr(dna, F.lit(offset + 1)), F.lit("(...)"), F.lit(1))
    return F.coalesce(F.array_join(F.transform(codons, lambda c: F.coalesce(table[c], F.lit(PROTEIN.unknown))), ""), F.lit(""))


def six_frames(seq: Column) -> Column:
    """array<struct<frame, seq>>: frames 0-2 forward, 3-5 on the reverse complement; none for fewer than 3 letters."""
    forward, backward = normalize(seq, DNA), reverse_complement(seq)
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), translate_frame(forward if f < 3 else backward, f % 3).alias("seq")) for f in range(6)])
    return F.when(F.length(seq) >= 3, frames).otherwise(F.array().cast("array<struct<frame:int,seq:string>>"))


def dna_start(position: Column, frame: Column, dna_length: Column) -> Column:
    """1-based DNA coordinate of a residue's first base (position 1-based inside the frame)."""
    return F.when(frame < 3, 3 * (position - 1) + frame + 1).otherwise(dna_length - (3 * (position - 1) + frame - 3))


def dna_end(position: Column, frame: Column, dna_length: Column) -> Column:
    """Of its last base; smaller than the start on the reverse strand."""
    return F.when(frame < 3, dna_start(position, frame, dna_length) + 2).otherwise(dna_start(position, frame, dna_length) - 2)


def context(classes: Column, position: Column, length: int = 10) -> Column:
    """The reduced classes of [position - length/2, position + length/2) packed four bits each (length up to 15); null where that leaves the sequence.

    position is 1-based; classes is a class string of digits and letters below 16.
    """
    half = length // 2
    inside = (position - 1 >= half) & (position - 1 + (length - half) <= F.length(classes))
    return F.when(inside, F.conv(F.substr(classes, position - half, F.lit(length)), 16, 10).cast("bigint"))


def nibble_distance(a: Column, b: Column) -> Column:
    """How many of the packed four-bit classes differ."""
    x = a.bitwiseXOR(b)
    folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))


def string_distance(a: Column, b: Column) -> Column:
    """Hamming distance of two class strings of equal length (any length)."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def context_distance(a: Column, b: Column, packed: bool) -> Column:
    """Differing classes of two contexts, packed or class strings."""
    return nibble_distance(a, b) if packed else string_distance(a, b)


def similarity_checked(position: Column, frame_length: Column, length: int = 10) -> Column:
    """Whether a seed's context lies inside its frame (1-based position)."""
    half = length // 2
    return (position - 1 >= half) & (position - 1 < frame_length - half)
