"""Expressions over taxonomic ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven canonical ranks, root side first.
RANKS = ("superkingdom", "phylum", "class", "order", "family", "genus", "species")
# Rank names, with and without a prefix, that are read as a rank, and those of them that are one rank.
NAMED_RANKS = "^(super|sub|infra|parv)?(domain|superkingdom|kingdom|phylum|class|order|family|genus|species|strain)$"
TOP_RANKS = ("domain", "kingdom", "superkingdom")


def canonical_rank(rank: Column) -> Column:
    """Canonical name of a rank: domain and kingdom are superkingdom, prefixes are dropped; NULL where there is none."""
    stem = F.regexp_extract(F.lower(rank), NAMED_RANKS, 2)
    return F.when(stem.isin(*TOP_RANKS), F.lit("superkingdom")).when(stem != "", stem)


def canonical_name(rank: str) -> str | None:
    """``canonical_rank`` of one name."""
    found = re.match(NAMED_RANKS, rank.lower())
    return found and ("superkingdom" if found[2] in TOP_RANKS else found[2])


def exact_rank(rank: Column) -> Column:
    """Rank names as output calls use them: kingdom is read as superkingdom, all else by its exact name."""
    return F.when(rank == "kingdom", F.lit("superkingdom")).when(rank.isin(*RANKS), rank)


def rank_index(rank: Column) -> Column:
    """Place of a canonical rank among the seven, -1 where it is none of them."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, RANKS)), rank) - 1, F.lit(-1)).cast("int")


def labels_to_seven(labels: Column) -> Column:
    """Rank labels as an array of seven: longer ones lose their first, shorter ones are padded with -1."""
    n = F.size(labels)
    return F.when(n > 7, F.slice(labels, 2, 7)).otherwise(F.concat(labels, F.array_repeat(F.lit(-1), F.greatest(F.lit(7) - n, F.lit(0)))))


def labels_by_name(labels: Column, names: list[str]) -> Column:
    """Rank labels under these names as an array of seven, -1 where no name is read as a rank; of several the last counts."""
    place = {canonical_name(name): k for k, name in enumerate(names)}
    return F.array(*(F.coalesce(F.get(labels, F.lit(place[r])), F.lit(-1)) if r in place else F.lit(-1) for r in RANKS))


def remap_index(index: Column, names: list[str]) -> Column:
    """Rank index under other names -> index among the seven, else -1."""
    out = F.lit(-1)
    for k, name in enumerate(names):
        if name in RANKS:
            out = F.when(index == k, F.lit(RANKS.index(name))).otherwise(out)
    return out


def targets_from_cutoff(cutoff: Column) -> Column:
    """Seven 0/1 targets: 1 up to and with the cutoff."""
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (i <= cutoff).cast("int"))


def cutoff_index(species_out: Column, genus_out: Column, family_out: Column) -> Column:
    """Deepest rank a sequence may be called at when its species, genus or family is left out of the reference."""
    place = RANKS.index
    return F.when(family_out, F.lit(place("order"))).when(genus_out, F.lit(place("family"))).when(species_out, F.lit(place("genus"))).otherwise(F.lit(place("species")))


#: Exclusion worlds, the rank that is left out in them, and the rank a call then backs off to.
WORLDS = {"S": ("species", "genus"), "G": ("genus", "family"), "F": ("family", "order")}


def cutoff_by_world(world: Column, species_out: Column, genus_out: Column, family_out: Column) -> Column:
    """Struct of cutoff (a rank), index, is_excluded and level: how deep a sequence may be called in an exclusion world.

    Only the rank that the world leaves out counts; CORE and unknown worlds allow species. Null flags are false.
    """
    level = F.lit("none")
    for name, out in zip(WORLDS, (species_out, genus_out, family_out), strict=True):
        level = F.when((world == name) & F.coalesce(out, F.lit(False)), F.lit(WORLDS[name][0])).otherwise(level)
    cutoff = F.lit("species")
    for excluded, deepest in WORLDS.values():
        cutoff = F.when(level == excluded, F.lit(deepest)).otherwise(cutoff)
    return F.struct(cutoff.alias("cutoff"), rank_index(cutoff).alias("index"), (level != "none").alias("is_excluded"), level.alias("level"))
