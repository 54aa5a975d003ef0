"""Read bases of pileup text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from locusforge.conventions import BASES

#: Longest insertion or deletion that the pattern names; rows with longer ones take the step-by-step form.
LONGEST_INDEL = 60
_INDEL = "|".join(rf"0*{n}(?![0-9]).{{{n}}}" for n in range(1, LONGEST_INDEL + 1))
#: What is dropped: a read start with its quality, a read end, an indel with its length and bases.
PATTERN = rf"(?s)\^.|\$|[+-](?:{_INDEL}|0+(?![0-9]))"
_ODD = rf"[+-](?:0*(?:{LONGEST_INDEL + 1}|[0-9]{{{len(str(LONGEST_INDEL)) + 1},}}|[{(LONGEST_INDEL + 1) // 10}-9][0-9]))"


def _step_by_step(c: Column) -> Column:
    """One pass over the characters. ``sign`` is a marker whose right side is not known yet, ``digits`` an indel's length."""

    def state(skip, sign, digits, out) -> Column:
        return F.struct(skip.cast("int").alias("skip"), sign.alias("sign"), digits.alias("digits"), out.alias("out"))

    none, zero, most = F.lit(""), F.lit(0), F.lit(2**31 - 2)

    def step(s: Column, x: Column) -> Column:
        def plain(out: Column) -> Column:
            return F.when(x == "$", state(zero, none, none, out)).when(x.isin("^", "+", "-"), state(zero, x, none, out)).otherwise(state(zero, none, none, F.concat(out, x)))

        size = F.least(F.coalesce(s["digits"].try_cast("bigint"), most), most)
        return (
            F.when(s["sign"] == "^", state(zero, none, none, s["out"]))
            .when(s["sign"].isin("+", "-") & x.rlike("^[0-9]$"), state(zero, s["sign"], F.concat(s["digits"], x), s["out"]))
            .when((s["digits"] != "") & (size > 0), state(size - 1, none, none, s["out"]))
            .when(s["skip"] > 0, state(s["skip"] - 1, none, none, s["out"]))
            .when((s["sign"] != "") & (s["digits"] == ""), plain(F.concat(s["out"], s["sign"])))
            .otherwise(plain(s["out"]))
        )

    start = state(zero, none, none, none)
    return F.aggregate(F.split(c, ""), start, step, lambda s: F.when(s["digits"] == "", F.concat(s["out"], s["sign"])).otherwise(s["out"]))


def clean_bases(c: Column | str) -> Column:
    """Read bases without markers, in upper case. Null stays null.

    ``^`` drops itself and the next character, ``$`` itself, ``+N``/``-N`` itself and N characters or as many as there
    are; a sign without a number and a ``^`` at the end stay. One regular expression does it, but for rows with indels
    that are longer than LONGEST_INDEL or cut short.
    """
    c = F.col(c) if isinstance(c, str) else c
    once = F.regexp_replace(c, PATTERN, "")
    # what the pattern could not take leaves a sign; a text whose qualities hold a sign then also goes step by step
    odd = c.rlike("[+-][0-9]") & (once.rlike("[+-]") | c.rlike(_ODD))
    return F.upper(F.when(odd, _step_by_step(c)).otherwise(once))


def count_base(cleaned: Column, base: str) -> Column:
    return (F.length(cleaned) - F.length(F.replace(cleaned, F.lit(base), F.lit("")))).cast("long")


def base_counts(cleaned: Column) -> list[Column]:
    return [count_base(cleaned, b).alias(b) for b in BASES]
