"""Ratcliff-Obershelp ratio of two words as a native column: the recursion over longest common blocks runs on an array as its stack."""

from pyspark.sql import Column, functions as F

#: In a word of so many letters, letters that are more than one in a hundred (and one) begin no block.
LONG, SHARE = 200, 100
MASK = "\x01"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _part(s: Column, start: Column, end: Column) -> Column:
    return F.substring(s, start + 1, end - start)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _masked(word: Column) -> Column:
    """A long word with its frequent letters masked; other words as they are."""
    often = lambda c: F.length(word) - F.length(F.replace(word, c, F.lit(""))) > F.floor(F.length(word) / SHARE) + 1
    return F.when(F.length(word) < LONG, word).otherwise(F.array_join(F.transform(F.split(word, ""), lambda c: F.when(often(c), F.lit(MASK)).otherwise(c)), ""))


def _common(a: Column, b: Column, last: bool) -> Column:
    """Letters that two strings have in common at their start, or at their end."""
    cut = (lambda s, n: F.right(s, n)) if last else (lambda s, n: F.left(s, n))
    return F.coalesce(F.array_max(F.transform(_upto(F.least(F.length(a), F.length(b))), lambda n: F.when(cut(a, n) == cut(b, n), n))), F.lit(0))


def _block(a: Column, b: Column, masked: Column, r: Column) -> Column:
    """(i, j, k): the longest block that the parts of a and b have in common, the first one in a, then in b."""
    inner = _part(masked, r["blo"], r["bhi"])
    runs = F.flatten(F.transform(F.sequence(r["alo"], r["ahi"] - 1), lambda i: F.transform(_upto(F.least(r["ahi"] - i, r["bhi"] - r["blo"])), lambda k: F.when(
        F.call_function("instr", inner, _part(a, i, i + k)) > 0, F.struct(k.alias("k"), (-i).alias("i"))))))
    best = F.coalesce(F.array_max(runs), F.struct(F.lit(0).alias("k"), (-r["alo"]).alias("i")))

    def placed(x: Column) -> Column:
        i, k = -x["i"], x["k"]
        j = F.when(k == 0, r["blo"]).otherwise(r["blo"] + F.call_function("instr", inner, _part(a, i, i + k)) - 1)
        return F.struct(i.alias("i"), j.alias("j"), k.alias("k"))

    def extended(m: Column) -> Column:
        left = _common(_part(a, r["alo"], m["i"]), _part(b, r["blo"], m["j"]), True)
        right = _common(_part(a, m["i"] + m["k"], r["ahi"]), _part(b, m["j"] + m["k"], r["bhi"]), False)
        return F.when(F.length(b) < LONG, m).otherwise(_let(F.when(m["k"] > 0, left).otherwise(F.lit(0)), lambda n: F.struct(
            (m["i"] - n).alias("i"), (m["j"] - n).alias("j"), (m["k"] + n + right).alias("k"))))

    return _let(_let(best, placed), extended)


def ratio(candidate: Column, word: Column) -> Column:
    """2 M / (letters of both), M being the letters of the longest common block and of those left and right of it.

    The order of the arguments matters: the candidate is compared with the word. The stack holds the parts still to be compared.
    """
    kind = "array<struct<alo:int,ahi:int,blo:int,bhi:int>>"

    def matched(x: Column) -> Column:
        a, b, masked = x["a"], x["b"], x["m"]
        part = lambda alo, ahi, blo, bhi: F.struct(alo.alias("alo"), ahi.alias("ahi"), blo.alias("blo"), bhi.alias("bhi"))

        def step(s: Column, _: Column) -> Column:
            def split(r: Column) -> Column:
                def after(m: Column) -> Column:
                    both = F.array(part(r["alo"], m["i"], r["blo"], m["j"]), part(m["i"] + m["k"], r["ahi"], m["j"] + m["k"], r["bhi"]))
                    more = F.when(m["k"] > 0, F.filter(both, lambda p: (p["alo"] < p["ahi"]) & (p["blo"] < p["bhi"]))).otherwise(F.array().cast(kind))
                    return F.struct(F.concat(F.slice(s["stack"], 1, F.size(s["stack"]) - 1), more).alias("stack"), (s["total"] + m["k"]).alias("total"))
                return _let(_block(a, b, masked, r), after)
            return F.when(F.size(s["stack"]) == 0, s).otherwise(_let(F.try_element_at(s["stack"], F.lit(-1)), split))

        whole = F.array(part(F.lit(0), F.length(a), F.lit(0), F.length(b))).cast(kind)
        start = F.struct(F.filter(whole, lambda p: (p["ahi"] > 0) & (p["bhi"] > 0)).alias("stack"), F.lit(0).alias("total"))
        return F.aggregate(_upto(2 * F.least(F.length(a), F.length(b)) + 1), start, step, lambda s: s["total"])

    letters = F.length(candidate) + F.length(word)
    pair = F.struct(candidate.alias("a"), word.alias("b"), _masked(word).alias("m"))
    return F.when(letters == 0, F.lit(1.0)).otherwise(F.lit(2.0) * _let(pair, matched) / letters)
