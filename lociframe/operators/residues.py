"""Residue tables of many structures: contacts, pockets, variants, conservation, superposition."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.ordering import ordinal_rank
from lociframe.operators.blocks import CELLS
from lociframe.operators.graph import connected_components
from lociframe.operators.neighbours import joined
from lociframe.session import cut_lineage, spread

# Three-letter to one-letter residue names.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def filter_residues(atoms: DataFrame, chain: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """C-alpha atoms that are no hetero atoms, of one chain and residue range when given."""
    out = atoms.where((F.trim("hetflag") == "") & (F.col("atom") == "CA"))
    if chain is not None:
        out = out.where(F.col("chain") == chain)
    if first is not None:
        out = out.where(F.col("resseq") >= first)
    if last is not None:
        out = out.where(F.col("resseq") <= last)
    return out



def contacts(res: DataFrame, reach: float = 8.0, keys: tuple[str, ...] = ("structure",), key: str = "rid") -> DataFrame:
    """Pairs of residues (a < b) of one structure within reach, met through a grid of that width.

    Each residue looks at its own cell and the 26 around it, so only near residues are ever compared.
    """
    cols = [*keys, key, "x", "y", "z"]
    base = res.select(*cols, *[F.floor(F.col(c) / reach).cast("long").alias(f"g{c}") for c in "xyz"])
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = base
    for c in "xyz":
        a = a.withColumn("d", F.explode(step)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("d")).drop("d")
    cell = [*keys, "gx", "gy", "gz"]
    left = a.select(*cell, F.col(key).alias("a"), *[F.col(c).alias(f"{c}a") for c in "xyz"])
    right = base.select(*cell, F.col(key).alias("b"), *[F.col(c).alias(f"{c}b") for c in "xyz"])
    d2 = sum(((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b")) for c in "xyz"), F.lit(0.0))
    return left.join(right, cell).where((F.col("a") < F.col("b")) & (d2 <= reach * reach)).select(
        *keys, "a", "b", F.sqrt(d2).alias("distance"))


def contact_links(res: DataFrame, reach: float = 8.0, keys: tuple[str, ...] = ("structure",), key: str = "rid") -> DataFrame:
    """Links (src, dst) whose components are those of the `contacts`, fewer than the residues of each meeting.

    A residue goes to its own cell and to the 13 cells behind it. There the cell's own residues meet each other and the
    guests, some at a time, and only the links of the groups they form leave the task, however many the contacts are.
    """
    cell = ["gx", "gy", "gz"]
    held = res.select(*keys, key, *[F.col(c).cast("double").alias(c) for c in "xyz"]).dropna()
    base = held.select(*held.columns, *[F.floor(F.col(c) / reach).cast("long").alias(g) for c, g in zip("xyz", cell)])
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(g) for g, d in zip(cell, s)]) for s in steps]))
    sides = base.withColumn("d", step).select(*keys, key, "x", "y", "z", *[(F.col(g) + F.col(f"d.{g}")).alias(g) for g in cell],
                                              (F.col("d") == F.struct(*[F.lit(0).alias(g) for g in cell])).alias("own"))
    kind = res.schema[key].dataType.simpleString()

    def work(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        column = pa.concat_arrays(table.column(key).chunks)
        names = column.dictionary_encode()
        node = names.indices.to_numpy()
        x = [table.column(c).to_numpy() for c in "xyz"]
        root = np.arange(len(names.dictionary))
        mine = np.flatnonzero(own)
        step = max(16, CELLS // len(table))
        for at in range(0, len(mine), step):
            i = mine[at:at + step]
            d2 = 0.0
            for c in x:
                d2 = d2 + (c[i, None] - c[None]) * (c[i, None] - c[None])
            a, b = np.nonzero(d2 <= reach * reach)
            root = joined(root, node[i[a]], node[b])
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"src": names.dictionary.take(pa.array(root[far])), "dst": names.dictionary.take(pa.array(far))})

    return spread(sides, *keys, *cell).groupBy(*keys, *cell).applyInArrow(work, f"src {kind}, dst {kind}")


def pockets(res: DataFrame, max_sasa: float = 25.0, reach: float = 8.0) -> DataFrame:
    """Buried residues grouped by contact (connected components), with the pocket as its smallest residue id.

    Residue ids must be unique over all structures.
    """
    buried = cut_lineage(res.where(F.col("sasa") < max_sasa))
    comp = connected_components(contact_links(buried, reach))
    return buried.join(comp, F.col("rid") == F.col("node"), "left").withColumn(
        "pocket", F.coalesce("component", "rid")).drop("node", "component")


def pocket_summary(pocket_rows: DataFrame) -> DataFrame:
    """Size, mean accessibility, centroid, chains and residues of each pocket, largest first by rank."""
    out = pocket_rows.groupBy("structure", "pocket").agg(
        F.count(F.lit(1)).alias("n_residues"), F.avg("sasa").alias("mean_sasa"), F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"), F.avg("z").alias("centroid_z"),
        F.array_join(F.sort_array(F.collect_set("chain")), ";").alias("chains"),
        F.array_join(F.transform(F.sort_array(F.collect_set("resseq")), lambda r: r.cast("string")), ";").alias("residues"))
    return ordinal_rank(out, ["structure"], "n_residues", "pocket", "pocket_rank", descending=True)


def solvent_class(sasa: Column) -> Column:
    return F.when(sasa.isNull(), "unknown").when(sasa < 25, "buried").when(sasa < 100, "intermediate").otherwise("exposed")


def structure_label(code: Column) -> Column:
    return F.when(code == "H", "Helix").when(code == "E", "Strand").otherwise("Coil")


def _tiles(rows: DataFrame, fields: list[str], name: str, tile: int) -> DataFrame:
    """Rows of each structure packed to arrays of about ``tile`` rows."""
    parts = rows.groupBy("structure").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    placed = rows.join(parts, "structure").withColumn("t", F.pmod(F.xxhash64(*fields), F.col("parts")))
    packed = placed.groupBy("structure", "t").agg(F.collect_list(F.struct(*fields)).alias("m"))
    return packed.select("structure", F.col("t").alias(f"{name}_tile"), *[F.col(f"m.{f}").alias(f"{name}_{f}") for f in fields])


def nearest_pocket(points: DataFrame, pocket_rows: DataFrame, near: float = 8.0, tile: int = 512) -> DataFrame:
    """Distance of each point (structure, vid, x, y, z) to the nearest pocket residue of its structure.

    Points and pocket residues meet as pairs of tiles. A pair of tiles returns one minimum per point, so
    a structure with very many residues is spread over tasks and its single pairs are never rows.
    """
    a = _tiles(points.select("structure", "vid", "x", "y", "z"), ["vid", "x", "y", "z"], "a", tile)
    b = _tiles(pocket_rows.select("structure", "x", "y", "z"), ["x", "y", "z"], "b", tile)
    pairs = spread(a.join(b, "structure"), "structure", "a_tile", "b_tile")

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                p = np.column_stack([np.asarray(v, dtype=float) for v in (r.a_x, r.a_y, r.a_z)])
                q = np.column_stack([np.asarray(v, dtype=float) for v in (r.b_x, r.b_y, r.b_z)])
                d2 = ((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2).min(axis=1)
                yield pd.DataFrame({"vid": np.asarray(r.a_vid), "d": np.sqrt(d2)})

    best = pairs.mapInPandas(smallest, f"vid {dict(points.dtypes)['vid']}, d double").groupBy("vid").agg(F.min("d").alias("pocket_distance"))
    return points.join(best, "vid", "left").withColumn("near_pocket", F.coalesce(F.col("pocket_distance") < near, F.lit(False)))


def annotate_variants(variants: DataFrame, residues: DataFrame, pocket_rows: DataFrame, chain: str | None = None) -> DataFrame:
    """Variants (structure, vid, wt_aa, pos, mut_aa) on their residue: names, match flag, classes, pocket distance.

    Without ``chain`` the first chain that has the position is taken.
    """
    res = residues if chain is None else residues.where(F.col("chain") == chain)
    fields = ["chain", "resname", "sasa", "ss", "bfactor", "x", "y", "z"]
    first = res.groupBy("structure", F.col("resseq").alias("pos")).agg(F.min(F.struct(*fields)).alias("r"))
    hit = variants.join(first, ["structure", "pos"]).select(*variants.columns, *[f"r.{f}" for f in fields])
    table = F.create_map(*[F.lit(v) for kv in THREE_TO_ONE.items() for v in kv])
    aa = F.coalesce(F.try_element_at(table, F.col("resname")), F.lit("X"))
    out = hit.withColumn("structure_aa", aa).withColumn(
        "wt_matches", F.when(F.col("wt_aa") != "?", F.col("structure_aa") == F.col("wt_aa"))
    ).withColumn("solvent_exposure", solvent_class(F.col("sasa"))).withColumn("secondary_structure", structure_label(F.col("ss")))
    return nearest_pocket(out, pocket_rows)


# ---- conservation --------------------------------------------------------------------------------


def column_conservation(msa: DataFrame) -> DataFrame:
    """1 - entropy / log2(21) of each alignment column (family, name, seq), with a 1 to 9 grade."""
    chars = msa.select("family", F.posexplode(F.split(F.upper("seq"), "")).alias("col", "ch")).where("ch <> ''")
    counts = chars.groupBy("family", "col", "ch").agg(F.count(F.lit(1)).alias("c"))
    # Entropy from Σ c·log2 c, so the column total needs no second pass.
    agg = counts.groupBy("family", "col").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    score = 1.0 - (F.log2("n") - F.col("s") / F.col("n")) / np.log2(21)
    out = agg.select("family", "col", "n", score.alias("conservation"))
    return out.withColumn("grade", F.greatest(F.lit(1), F.least(F.lit(9), F.floor(F.round(F.col("conservation") * 8, 9)) + 1)))


def map_columns_to_residues(query: DataFrame, scores: DataFrame, residues: DataFrame) -> DataFrame:
    """Scores of the non-gap columns of each family's query row, laid on its residues in order.

    residues: family, ordinal (0-based), chain, resseq, resname.
    """
    chars = F.split("seq", "")
    kept = F.filter(F.transform(chars, lambda ch, i: F.struct(ch.alias("ch"), i.alias("col"))), lambda s: (s["ch"] != "-") & (s["ch"] != ""))
    placed = query.select("family", F.posexplode(F.transform(kept, lambda s: s["col"])).alias("ordinal", "col"))
    return placed.join(scores, ["family", "col"]).join(residues, ["family", "ordinal"]).select(
        "family", "chain", "resseq", "resname", F.round("conservation", 4).alias("conservation_score"), "grade")


# ---- superposition -------------------------------------------------------------------------------


def pair_residues(first: DataFrame, second: DataFrame) -> DataFrame:
    """Residues of two structures with the same (pair, chain, resseq)."""
    a = first.select("pair", "chain", "resseq", "resname", *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = second.select("pair", "chain", "resseq", *[F.col(c).alias(f"{c}2") for c in "xyz"])
    return a.join(b, ["pair", "chain", "resseq"])


_MOVE = "pair string, n long, rmsd double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)) + \
    ", " + ", ".join(f"t{i} double" for i in range(3))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.to_dict("records"):
            n = r["n"]
            s1 = np.array([r[f"s1{c}"] for c in "xyz"])
            s2 = np.array([r[f"s2{c}"] for c in "xyz"])
            cross = np.array([[r[f"m{a}{b}"] for b in "xyz"] for a in "xyz"]) - np.outer(s2, s1) / n
            spread = r["q1"] - s1 @ s1 / n + r["q2"] - s2 @ s2 / n
            u, d, vt = np.linalg.svd(cross)
            flip = np.sign(np.linalg.det(u @ vt))
            d[-1] *= flip
            u[:, -1] *= flip
            rot = u @ vt
            move = s1 / n - s2 / n @ rot
            row = {"pair": r["pair"], "n": n, "rmsd": float(np.sqrt(max(0.0, spread - 2 * d.sum()) / n))}
            row.update({f"r{i}{j}": rot[i, j] for i in range(3) for j in range(3)})
            row.update({f"t{i}": move[i] for i in range(3)})
            out.append(row)
        if out:
            yield pd.DataFrame(out)


def superposition(pairs: DataFrame) -> DataFrame:
    """Least-squares rotation and shift of the second onto the first structure of every pair, with RMSD.

    The residues of a pair reduce to sums and nine cross moments; only that one row per pair is solved
    (a 3×3 decomposition) in Arrow batches.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in "xyz":
        aggs += [F.sum(f"{c}1").alias(f"s1{c}"), F.sum(f"{c}2").alias(f"s2{c}")]
        aggs += [F.sum(F.col(f"{c}2") * F.col(f"{b}1")).alias(f"m{c}{b}") for b in "xyz"]
    for k in (1, 2):
        aggs.append(F.sum(sum((F.col(f"{c}{k}") * F.col(f"{c}{k}") for c in "xyz"), F.lit(0.0))).alias(f"q{k}"))
    sums = pairs.groupBy(F.col("pair").cast("string").alias("pair")).agg(*aggs)
    return sums.mapInPandas(_solve, _MOVE)


def residue_distances(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """Distance of each paired residue after the second structure is moved."""
    joined = pairs.withColumn("pair", F.col("pair").cast("string")).join(moves, "pair")
    d2 = F.lit(0.0)
    for j, c in enumerate("xyz"):
        moved = F.col("x2") * F.col(f"r0{j}") + F.col("y2") * F.col(f"r1{j}") + F.col("z2") * F.col(f"r2{j}") + F.col(f"t{j}")
        d2 = d2 + (F.col(f"{c}1") - moved) * (F.col(f"{c}1") - moved)
    return joined.select("pair", "chain", "resseq", "resname", F.sqrt(d2).alias("distance"))
