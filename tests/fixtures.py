"""Small profiles: three scaffolds of 10, 20 and 30 positions in two genomes, with genes."""

from __future__ import annotations

import random

SIZES = {"chr1": 10, "chr2": 20, "chr3": 30}
GENES = {"chr1": {"gene1": (2, 5)}, "chr2": {"gene2": (2, 6), "gene3": (11, 15)}, "chr3": {"gene1": (3, 6), "gene2": (11, 15), "gene3": (22, 26)}}
STB = [("chr1", "genome1"), ("chr2", "genome1"), ("chr3", "genome2")]
PROFILE = "sample string, chrom string, pos long, gene string, A int, C int, G int, T int"


def gene_of(chrom: str, pos: int) -> str:
    return next((g for g, (a, e) in GENES[chrom].items() if a <= pos <= e), "NA")


def rows(sample: str, seed: int = 1, chroms=tuple(SIZES), flips=()) -> list[tuple]:
    """Seeded counts, the same for every sample of a seed; flips: (chrom, pos) whose bases are turned around."""
    r, out = random.Random(seed), []
    for chrom, n in SIZES.items():
        for pos in range(n):
            counts = [r.choice([0, 0, 1, 3, 12]) for _ in range(4)]
            if chrom in chroms:
                out.append((sample, chrom, pos, gene_of(chrom, pos), *(counts[::-1] if (chrom, pos) in flips else counts)))
    return out


def brute(p1: list[tuple], p2: list[tuple], similar, min_cov: int, min_gene: int) -> dict:
    """Genome statistics of one pair, computed row by row."""
    genome = dict(STB)
    other = {(r[1], r[2]): r[4:] for r in p2 if sum(r[4:]) >= min_cov}
    loci = [(r[1], r[2], r[3], similar(r[4:], other[r[1], r[2]])) for r in sorted(p1, key=lambda r: r[1:3]) if sum(r[4:]) >= min_cov and (r[1], r[2]) in other]
    out = {}
    for g in sorted({genome[x[0]] for x in loci}):
        own = [x for x in loci if genome[x[0]] == g]
        longest, run, last = 0, 0, None
        for chrom, _, _, s in own:
            run = 1 if chrom != last or not s else run + 1
            longest, last = max(longest, run), chrom
        genes = {}
        for _, _, name, s in own:
            if name != "NA":
                n, k = genes.get(name, (0, 0))
                genes[name] = n + 1, k + bool(s)
        long = [v for v in genes.values() if v[0] >= min_gene]
        same = sum(n == k for n, k in long)
        share = sum(bool(x[3]) for x in own)
        out[g] = (len(own), share, share / len(own) * 100, longest, len(long) or None, same if long else None, same / len(long) * 100 if long else None)
    return out
