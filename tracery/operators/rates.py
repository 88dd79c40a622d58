"""Which key of a rate card a model's name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(c: Column) -> Column:
    """Letters a to z and digits, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical(c: Column) -> Column:
    """What stands after the last slash, plain."""
    return _plain(F.substring_index(c, "/", -1))


def provider(c: Column) -> Column:
    """What stands before the last slash, plain; '' without one."""
    return _plain(F.regexp_extract(c, r"(?s)^(.+)/[^/]*\z", 1))


def undecorated(c: Column) -> Column:
    """The name without one group in brackets or parentheses at its end."""
    return F.regexp_replace(c, r"(?s)^(.*[^ ]) *(?:\([^(]*\)|\[[^\[]*\]) *\z", "$1")


def undated(c: Column) -> Column:
    """The name without a date of eight digits at its end."""
    return F.regexp_replace(c, r"(?s)^(.+)-[0-9]{8}\z", "$1")


def resolve(names: DataFrame, keys: DataFrame) -> DataFrame:
    """Each distinct model of names with the key of keys (column key) that it means, and the stage that found it; nulls where none does.

    Stages: 0 the name itself; 1 with dashes for dots; 2 and 3 the same in any case (ties to the lesser key); 4 to 6 by canonical form, of the name,
    then without its decoration, then without its date too. In 4 to 6 a key of another provider never counts, one of the same provider comes
    first, then one without, then any for a name without; several keys at the first rank that has any leave the name without a key.

    Both sides become rows of (kind, form), joined once by these; so each stage is part of one equi-join over distinct names.
    """
    m, k = F.col("model"), F.col("key")
    dashed = F.replace(m, F.lit("."), F.lit("-"))
    bare = undecorated(m)
    form = lambda stage, kind, value: F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), value.alias("form"))
    forms = [form(0, "as it is", m), form(1, "as it is", dashed), form(2, "any case", F.lower(m)), form(3, "any case", F.lower(dashed)), form(4, "canonical", canonical(m)), form(5, "canonical", canonical(bare)), form(6, "canonical", canonical(undated(bare)))]
    asked = names.select("model").where("model is not null").distinct()
    wanted = asked.select("model", provider(m).alias("own"), F.inline(F.array(*forms))).where("kind <> 'canonical' or form <> ''")
    wanted = wanted.groupBy("model", "own", "kind", "form").agg(F.min("stage").alias("stage"))
    given = keys.select("key").where("key is not null").distinct()
    given = given.select("key", provider(k).alias("theirs"), F.inline(F.array(*(F.struct(F.lit(a).alias("kind"), b.alias("form")) for a, b in (("as it is", k), ("any case", F.lower(k)), ("canonical", canonical(k)))))))
    met = wanted.join(given, ["kind", "form"]).where("kind <> 'canonical' or own = '' or theirs = '' or own = theirs")
    rank = F.when((F.col("kind") != "canonical") | ((F.col("theirs") != "") & (F.col("theirs") == F.col("own"))), 0).when(F.col("theirs") == "", 1).otherwise(2)
    ranked = met.groupBy("model", "stage", rank.alias("rank")).agg(F.min("key").alias("key"), ((F.col("stage") > 3) & (F.count(F.lit(1)) > 1)).alias("unclear"))
    first = ranked.groupBy("model").agg(F.min(F.struct("stage", "rank", "key", "unclear")).alias("f"))
    return asked.join(first, "model", "left").select("model", F.when(~F.col("f.unclear"), F.col("f.key")).alias("key"), F.when(~F.col("f.unclear"), F.col("f.stage")).alias("stage"))
