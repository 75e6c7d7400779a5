"""Column functions over nucleotide and amino-acid strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociframe.functions.special import let

# IUPAC nucleotide codes.
IUPAC_CODES = {
    "N": "ACGT", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG",
}

# Single-nucleotide weights by 1-based spacer position (published rule set, simplified).
SPACER_WEIGHTS = {
    1: {"G": -0.2753}, 2: {"A": 0.1081}, 3: {"C": -0.0118, "T": 0.0736}, 4: {"A": 0.0938, "G": -0.0170},
    6: {"A": 0.0372}, 7: {"A": 0.0541}, 9: {"C": -0.0613}, 10: {"G": -0.1000}, 12: {"A": -0.0109},
    13: {"G": 0.0617}, 15: {"C": -0.1190}, 16: {"G": 0.1316, "T": -0.1584}, 17: {"T": -0.2279},
    18: {"G": -0.0649, "T": 0.1326}, 19: {"C": 0.1626}, 20: {"G": -0.4075, "T": 0.7001},
}

# Dinucleotide weights by 1-based spacer position of the first base.
SPACER_PAIR_WEIGHTS = {
    (1, "GT"): -0.6257, (3, "GC"): 0.3004, (4, "AA"): -0.8348, (10, "GG"): -0.5873, (13, "TT"): -0.3372,
    (15, "GG"): 0.1715, (16, "TA"): -0.4008, (17, "GG"): 0.2458, (18, "TC"): 0.2224, (19, "TT"): -0.6847,
}
SPACER_INTERCEPT = 0.5976

# Nearest-neighbour terms of the primer melting temperature.
PAIR_TM = {
    "AA": 9.6, "TT": 9.6, "AT": 9.6, "TA": 9.6, "CA": 13.8, "GT": 13.8, "CT": 10.4, "AG": 10.4,
    "GA": 13.8, "TC": 13.8, "GC": 14.4, "CG": 14.4, "GG": 13.8, "CC": 13.8, "AC": 12.4, "TG": 12.4,
}

# Residue masses (Da).
RESIDUE_MASS = {
    "A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.15, "Q": 146.15, "E": 147.13, "G": 75.07,
    "H": 155.16, "I": 131.18, "L": 131.18, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09,
    "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15,
}
WATER = 18.015

# Residue charge at neutral pH.
RESIDUE_CHARGE = {"R": 1.0, "D": -1.0, "E": -1.0, "H": 0.1, "K": 1.0}

# Hydropathy scale (Kyte and Doolittle).
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}

# Helix propensity (Chou and Fasman).
HELIX = {
    "A": 1.42, "R": 0.98, "N": 0.67, "D": 1.01, "C": 0.70, "Q": 1.11, "E": 1.51, "G": 0.57, "H": 1.00, "I": 1.08,
    "L": 1.21, "K": 1.16, "M": 1.45, "F": 1.13, "P": 0.57, "S": 0.77, "T": 0.83, "W": 1.08, "Y": 0.69, "V": 1.06,
}

# pKa of basic and acidic side chains used by the charge balance.
PKA_BASIC = {"K": 3.5, "R": 3.1}
PKA_ACIDIC = {"D": 4.0, "E": 4.2}

# Dipeptide instability weights that are not zero.
INSTABILITY = {"AD": 0.23, "RD": 0.22, "DA": 0.23, "EA": 0.37, "LA": 0.13}

# Motif patterns.
MOTIFS = {
    "NLS": "K[KR]{2}|KR",
    "NES": "L.{2,3}[LIVMF].{2,3}[LIVMF].L",
    "RGD": "RGD",
    "CAAX": "C[AVILM]{2}[AVILM]$",
    "N-glycosylation": "N[^P][ST]",
    "SH2 binding": "Y[A-Z]{2}[LIVMF]",
    "SH3 binding": "P.{2}P",
}


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; every letter outside ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def iupac_regex(pam: str) -> str:
    return "".join(f"[{IUPAC_CODES[c]}]" if c in IUPAC_CODES else c for c in pam.upper())


def iupac_regex_reverse(pam: str) -> str:
    """Pattern of the reverse complement of a PAM."""
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    return "".join("[" + "".join(pair[b] for b in IUPAC_CODES.get(c, c)) + "]" for c in reversed(pam.upper()))


def count_char(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def gc_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) == 0, 0.0).otherwise(
        F.length(F.regexp_replace(seq, "[^GC]", "")) / F.greatest(F.length(seq), F.lit(1)).cast("double"))


def is_problematic(seq: Column) -> Column:
    """Poly-T of four, the restriction site, or any run of five."""
    return seq.rlike("TTTT|CACCG|A{5}|C{5}|G{5}|T{5}")


def spacer_score(spacer: Column) -> Column:
    """Logistic score of a spacer from position, pair, GC, seed and run terms.

    The terms stand inside `let`: written out in generated code they make a method too long to be compiled.
    """

    def terms(s: Column) -> Column:
        raw = F.lit(SPACER_INTERCEPT)
        for pos, weights in SPACER_WEIGHTS.items():
            base = F.substring(s, pos, 1)
            for letter, w in weights.items():
                raw = raw + F.when(base == letter, w).otherwise(0.0)
        for (pos, pair), w in SPACER_PAIR_WEIGHTS.items():
            raw = raw + F.when(F.substring(s, pos, 2) == pair, w).otherwise(0.0)

        def shares(g: Column) -> Column:
            gc, seed = g["gc"], g["seed"]
            out = raw - 0.2026 * F.abs(gc - 0.55) - F.when((gc < 0.3) | (gc > 0.75), 0.15).otherwise(0.0)
            out = out - F.when(seed > 0.75, 0.15).when(seed < 0.25, 0.08).otherwise(0.0)
            for letter in "ACGT":
                out = out - F.when(F.contains(s, F.lit(letter * 4)), 0.10).otherwise(0.0)
            return 1.0 / (1.0 + F.exp(-out))

        return let(F.struct(gc_fraction(s).alias("gc"), gc_fraction(F.substring(s, -4, 4)).alias("seed")), shares)

    return let(spacer, terms)


def editing_efficiency(proto: Column) -> Column:
    """Heuristic efficiency of a base-editor protospacer in 0..1."""
    gc = gc_fraction(proto)
    s = F.lit(0.5) + F.when(F.substring(proto, 1, 1) == "G", 0.05).otherwise(0.0)
    s = s - F.when(F.contains(proto, F.lit("TTTT")), 0.20).when(F.contains(proto, F.lit("TTT")), 0.10).otherwise(0.0)
    s = s + F.when(gc.between(0.40, 0.70), 0.10).when((gc < 0.20) | (gc > 0.80), -0.15).otherwise(0.0)
    s = s - F.when(F.substring(proto, -1, 1) != "G", 0.03).otherwise(0.0)
    for letter in "ACGT":
        s = s - F.when(F.contains(proto, F.lit(letter * 4)), 0.08).otherwise(0.0)
    seed = F.substring(proto, -12, 12)
    s = s - F.when(F.substring(seed, 1, 6) == reverse_complement(F.substring(seed, 7, 6)), 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3)


def window_positions(proto: Column, first: int, last: int, targets: str) -> Column:
    """1-based positions in the editing window that hold a target base."""
    found = [F.when(F.substring(proto, p, 1).isin(*targets), F.lit(p)) for p in range(first, last + 1)]
    return F.array_compact(F.array(*found))


def edit_outcomes(proto: Column, positions: Column, target: str) -> Column:
    new = "T" if target[0] == "C" else "G"
    return F.array_join(F.transform(positions, lambda p: F.concat(
        F.lit("pos"), p.cast("string"), F.lit(":"), F.substr(proto, p, F.lit(1)), F.lit(f">{new}"))), "; ")


def melting_temperature(seq: Column) -> Column:
    """Mean of the 4·GC + 2·AT rule and the nearest-neighbour sum."""
    table = F.create_map(*[F.lit(v) for kv in PAIR_TM.items() for v in kv])
    pairs = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(seq) - 1, F.lit(1))), F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.try_element_at(table, F.substr(seq, i, F.lit(2))), F.lit(12.0)))
    gc = F.length(F.regexp_replace(seq, "[^GC]", ""))
    at = F.length(F.regexp_replace(seq, "[^AT]", ""))
    return F.when(F.length(seq) < 2, 0.0).otherwise((4.0 * gc + 2.0 * at + pairs) / 2.0)


def primer_binding_site(spacer: Column, shortest: int = 8, longest: int = 17, optimum: float = 33.0) -> Column:
    """STRUCT<gap, len, pbs, tm>: the prefix of the reverse complement whose melting point is nearest the optimum.

    One walk along the letters carries the sums that `melting_temperature` makes of each prefix.
    """
    table = F.create_map(*[F.lit(v) for kv in PAIR_TM.items() for v in kv])

    def walk(rc: Column) -> Column:
        def letter(acc: Column, i: Column) -> Column:
            held = i <= F.length(rc)
            ch = F.substr(rc, i, F.lit(1))
            pair = F.when(held & (i > 1), F.coalesce(F.try_element_at(table, F.substr(rc, i - 1, F.lit(2))), F.lit(12.0))).otherwise(0.0)
            return let(F.struct(
                (acc["pairs"] + pair).alias("pairs"), (acc["gc"] + F.when(held & ch.isin("G", "C"), 1).otherwise(0)).alias("gc"),
                (acc["at"] + F.when(held & ch.isin("A", "T"), 1).otherwise(0)).alias("at"), acc["best"].alias("best")), lambda s: chosen(s, i))

        def chosen(s: Column, i: Column) -> Column:
            tm = F.when(F.length(rc) < 2, 0.0).when(F.length(rc) >= 2, (4.0 * s["gc"] + 2.0 * s["at"] + s["pairs"]) / 2.0)
            option = let(tm, lambda t: F.struct(F.abs(t - optimum).alias("gap"), i.alias("len"), F.substr(rc, F.lit(1), i).alias("pbs"), t.alias("tm")))
            # The least of the two, where null is no option yet.
            return F.struct(s["pairs"].alias("pairs"), s["gc"].alias("gc"), s["at"].alias("at"),
                            F.when(i < shortest, s["best"]).otherwise(F.least(s["best"], option)).alias("best"))

        start = F.struct(F.lit(0.0).alias("pairs"), F.lit(0).alias("gc"), F.lit(0).alias("at"),
                         F.lit(None).cast("struct<gap:double,len:int,pbs:string,tm:double>").alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(longest)), start, letter, lambda a: a["best"])

    return let(reverse_complement(spacer), walk)


def prime_guide_score(spacer: Column, tm: Column) -> Column:
    """Heuristic of GC, primer melting point, runs and seed GC in 0..1."""
    gc, gap = gc_fraction(spacer), F.abs(tm - 33.0)
    s = F.when(gc.between(0.4, 0.7), 1.0).otherwise(0.5) * 0.3
    s = s + F.when(gap < 5.0, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - gap / 20.0)) * 0.3
    s = s + F.when(spacer.rlike("TTTT|AAAA"), -0.1).otherwise(0.2)
    s = s + F.least(gc_fraction(F.substring(spacer, -17, 17)), F.lit(1.0)) * 0.2
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


# ---- proteins ------------------------------------------------------------------------------------


def is_protein(seq: Column) -> Column:
    return F.upper(seq).rlike("^[ACDEFGHIKLMNPQRSTVWY]*$")


def weighted_letters(seq: Column, weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for letter, w in weights.items():
        total = total + count_char(seq, letter) * w
    return total


def molecular_weight(seq: Column) -> Column:
    return weighted_letters(seq, RESIDUE_MASS) - (F.length(seq) - 1) * WATER


def gravy(seq: Column) -> Column:
    return weighted_letters(seq, HYDROPATHY) / F.length(seq)


def helix_propensity(seq: Column) -> Column:
    return weighted_letters(seq, HELIX) / F.length(seq)


def isoelectric_point(seq: Column, basic: dict[str, float] = PKA_BASIC, acidic: dict[str, float] = PKA_ACIDIC) -> Column:
    """pH of zero net charge between 2 and 12 after fifty halvings."""
    counts = F.struct(*[count_char(seq, c).alias(c) for c in [*basic, *acidic]])

    def charge(n: Column, ph: Column) -> Column:
        q = F.lit(0.0)
        for c, pka in basic.items():
            q = q + n[c] / (1.0 + F.pow(F.lit(10.0), pka - ph))
        for c, pka in acidic.items():
            q = q - n[c] / (1.0 + F.pow(F.lit(10.0), ph - pka))
        return q

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2.0
        up = charge(acc["n"], mid) > 0
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"),
                        acc["n"].alias("n"))

    start = F.struct(F.lit(2.0).alias("lo"), F.lit(12.0).alias("hi"), counts.alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2.0)


def instability_index(seq: Column, table: dict[str, float] = INSTABILITY) -> Column:
    """Mean dipeptide weight times 100; overlapping pairs count."""
    total = F.lit(0.0)
    for pair, w in table.items():
        total = total + F.regexp_count(seq, F.lit(f"{pair[0]}(?={pair[1]})")) * w
    return total / (F.length(seq) - 1) * 100


def disorder_flags(seq: Column, window: int = 20) -> Column:
    """1 for each residue whose window is hydrophilic (mean < -0.5) and charged (|mean| > 0.3), else 0."""
    half = window // 2

    def judge(piece: Column) -> Column:
        hydro = weighted_letters(piece, HYDROPATHY) / F.length(piece)
        charge = weighted_letters(piece, RESIDUE_CHARGE) / F.length(piece)
        return F.when((hydro < -0.5) & (F.abs(charge) > 0.3), 1).otherwise(0)

    def scan(s: Column) -> Column:
        def flag(i: Column) -> Column:
            lo = F.greatest(F.lit(1), i - half)
            return let(F.substr(s, lo, F.least(F.length(s), i + half - 1) - lo + 1), judge)

        return F.transform(F.sequence(F.lit(1), F.length(s)), flag)

    return let(seq, scan)


def motif_hits(seq: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, hit>> of non-overlapping matches, 0-based half-open."""

    def scan(s: Column) -> Column:
        found = F.struct(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)).alias("hits"), F.split(s, pattern, -1).alias("gaps"))
        return let(found, lay_out)

    def lay_out(f: Column) -> Column:
        def place(h: Column, i: Column) -> Column:
            before = F.length(F.array_join(F.slice(f["gaps"], F.lit(1), i + 1), "")) + F.length(
                F.array_join(F.slice(f["hits"], F.lit(1), i), ""))
            return let(before, lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("hit")))

        return F.transform(f["hits"], place)

    return let(seq, scan)
