"""Secret scan in DataFrame functions only: patterns, and the Shannon entropy of sliding windows by character class.

Matches of a pattern come from ``regexp_extract_all``, their places from the lengths of what ``split`` leaves between
them. Candidate strings for the entropy are runs of 20 or more base64 characters. A window of 20 characters slides over
a candidate; with counts c of its characters, S = sum of c log2 c changes by the character that leaves and the one that
enters, and the window's entropy is log2(20) - S / 20. A candidate is reported if a window reaches the threshold of its
character class (hexadecimal, or mixed) and no allow-list pattern suppresses it. The counts are five bits each, packed
into ``WORDS`` longs; a step changes two of them.

Everything works row by row in one narrow pass: no shuffle, no Python. Cost is linear in the text; sums and maxima over
the n matches of a text are carried on in blocks of sqrt(n), as arrays only grow by being copied.

Defined cases: a null or empty text has no spans; overlapping spans of different kinds are all reported, but a
candidate inside a base span isn't reported again; rows with equal ids are scanned each by itself; an empty table gives
an empty result; other columns are ignored by ``find`` and kept by ``redact``.
"""

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 20
#: Least entropy, in bits per character, of a window of each class.
HEX_BITS, MIXED_BITS = 3.01, 3.81
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed"]
BASE_KINDS = KINDS[:3]


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = ("(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key") + ")"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A run of one class is matched from its first character to its last, so least lengths can stand in the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
#: Candidates that aren't secrets: words and numbers, rulers, paths and joined words, stated examples.
ALLOW = ["^[A-Za-z]+$", "^[0-9]+$", "^(.)\\1+$", "^[A-Za-z]+[-_/+=][A-Za-z_/+=-]*$", "(?i)example|placeholder|changeme"]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, carry, first: int = 0) -> Column:
    """For each of an array of ints what ``carry`` makes of all before it, from ``first`` on."""
    none = F.array().cast("array<int>")

    def run(block: Column) -> Column:
        step = lambda s, x: F.struct(carry(s["now"], x).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all"))
        return F.aggregate(block, F.struct(F.lit(first).alias("now"), none.alias("all")), step)

    def dealt(x: Column, n: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda i: run(F.slice(x, i * size + 1, size)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, run(F.transform(b, lambda r: r["now"]))["all"], lambda r, at: F.transform(r["all"], lambda v: carry(at, v)))))

    return let(values, lambda x: F.when(F.size(x) == 0, none).otherwise(let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda size: dealt(x, F.size(x), size))))


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match starts: the lengths of all pieces up to it and of the matches before."""
    lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
    return F.zip_with(let(lengths, lambda x: before(x, lambda a, b: a + b)), F.slice(pieces, 1, F.size(found)), lambda at, p: at + F.length(p))


def matches(text: Column, pattern: str, least: Column | int = 0, group: int = 0) -> Column:
    """(start, end, string) of the leftmost matches that don't overlap and whose group has the least length."""
    def places(found: Column) -> Column:
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        rows = F.zip_with(F.arrays_zip(found.alias("f"), inner.alias("g")), let(F.split(text, pattern, -1), lambda p: _starts(p, found)),
                          lambda m, at: F.struct(at.alias("start"), (at + F.length(m["f"])).alias("end"), m["f"].alias("string"), F.length(m["g"]).alias("size")))
        return F.filter(F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<start:int,end:int,string:string,size:int>>")),
                        lambda m: m["size"] >= least)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _weight(k: Column) -> Column:
    return F.get(F.array(*[F.lit(k * log2(k) if k else 0.0) for k in range(WINDOW + 2)]), k)


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


#: Counts of five bits in a long; candidates have characters from + to z.
PER_WORD, FIRST = 12, ord("+")
WORDS = -(-(ord("z") - FIRST + 1) // PER_WORD)


def least_weight(chars: Column) -> Column:
    """The least S of any window over an array of characters, from incremental counts."""
    def window(codes: Column) -> Column:
        word = lambda x: F.floor(x / PER_WORD).cast("int")
        bits = lambda x: (x % PER_WORD) * 5
        one = lambda x: _shift("shiftleft", F.lit(1).cast("bigint"), bits(x))

        def count(s: Column, x: Column) -> Column:
            own = s["w0"]
            for j in range(1, WORDS):
                own = F.when(word(x) == j, s[f"w{j}"]).otherwise(own)
            return _shift("shiftright", own, bits(x)).bitwiseAND(F.lit(31).cast("bigint")).cast("int")

        def fill(s: Column, x: Column) -> Column:
            return F.struct(*((s[f"w{j}"] + F.when(word(x) == j, one(x)).otherwise(0)).alias(f"w{j}") for j in range(WORDS)))

        def slide(s: Column, i: Column) -> Column:
            def moved(out: Column, into: Column) -> Column:
                leaves, enters = count(s, out), count(s, into)
                now = s["now"] - _weight(leaves) + _weight(leaves - 1) - _weight(enters) + _weight(enters + 1)
                words = [(s[f"w{j}"] - F.when(word(out) == j, one(out)).otherwise(0) + F.when(word(into) == j, one(into)).otherwise(0)).alias(f"w{j}") for j in range(WORDS)]
                return let(now, lambda v: F.struct(*words, v.alias("now"), F.least(v, s["least"]).alias("least")))
            return let(F.struct(F.get(codes, i).alias("out"), F.get(codes, i + WINDOW).alias("into")), lambda x: F.when(x["out"] == x["into"], s).otherwise(moved(x["out"], x["into"])))

        empty = F.struct(*(F.lit(0).cast("bigint").alias(f"w{j}") for j in range(WORDS)))
        steps = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(0), F.size(codes) - WINDOW - 1)).otherwise(F.array().cast("array<int>"))
        head = F.slice(codes, 1, WINDOW)

        def start(s: Column) -> Column:
            weight = F.aggregate(F.array_distinct(head), F.lit(0.0), lambda w, x: w + _weight(count(s, x)))
            return let(weight, lambda w: F.struct(*(s[f"w{j}"].alias(f"w{j}") for j in range(WORDS)), w.alias("now"), w.alias("least")))

        return let(let(F.aggregate(head, empty, fill), start), lambda s: F.aggregate(steps, s, slide, lambda s: s["least"]))

    return let(F.transform(chars, lambda c: F.ascii(c) - FIRST), window)


def high_entropy(text: Column, allow: list[str]) -> Column:
    """(kind, start, end) of the candidates with a window of high entropy that no allow-list pattern suppresses."""
    plain = F.lit(False)
    candidates = matches(text, CANDIDATE)
    kept = F.filter(candidates, lambda m: ~_any(plain, [m["string"].rlike(p) for p in allow]))
    bits = lambda m: F.lit(log2(WINDOW)) - let(F.regexp_extract_all(m["string"], F.lit("[^\\n]"), F.lit(0)), least_weight) / WINDOW
    is_hex = lambda m: m["string"].rlike("^[0-9A-Fa-f]+$")
    rated = F.transform(kept, lambda m: F.struct(F.when(is_hex(m), F.lit(KINDS[3])).otherwise(F.lit(KINDS[4])).alias("kind"),
                                                 m["start"].alias("start"), m["end"].alias("end"), bits(m).alias("bits")))
    high = F.filter(rated, lambda m: m["bits"] >= F.when(m["kind"] == KINDS[3], HEX_BITS).otherwise(MIXED_BITS))
    return F.transform(high, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _any(first: Column, more: list[Column]) -> Column:
    for c in more:
        first = first | c
    return first


def spans(text: Column, allow: list[str] = ALLOW) -> Column:
    """array<kind, start, end> in code points, end exclusive, by start, then kind as listed."""
    of = lambda kind, rows: F.transform(rows, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    base = F.concat(of("assign", matches(text, ASSIGN, 6, 2)), of("access", matches(text, ACCESS)), of("hex", matches(text, HEX)))
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    keyed = lambda rows: F.transform(rows, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    def outside(rows: Column) -> Column:
        """Without candidates that lie inside a base span: base spans that start no later have all ended before."""
        is_base = lambda s: s["rank"] <= len(BASE_KINDS)
        ends = F.transform(rows, lambda s: F.when(is_base(s), s["end"]).otherwise(0))
        placed = F.zip_with(rows, before(ends, lambda a, b: F.greatest(a, b)), lambda s, most: F.struct(s.alias("s"), most.alias("most")))
        return F.transform(F.filter(placed, lambda x: is_base(x["s"]) | (x["most"] < x["s"]["end"])),
                           lambda x: F.struct(x["s"]["kind"].alias("kind"), x["s"]["start"].alias("start"), x["s"]["end"].alias("end")))

    return let(F.array_sort(keyed(F.concat(base, high_entropy(text, allow)))), outside)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] = ALLOW) -> DataFrame:
    """doc_id and spans of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), let(text, lambda t: spans(t, allow)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", allow: list[str] = ALLOW) -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark. No document goes."""
    def cut(x: Column) -> Column:
        wide, found = x["w"], x["s"]
        part = lambda at, end: F.decode(F.substring(wide, at * 4 + 1, F.greatest(end - at, F.lit(0)) * 4), "UTF-32")
        ends = F.transform(found, lambda m: m["end"])
        kept = F.zip_with(found, before(ends, lambda a, b: F.greatest(a, b)), lambda m, at: F.when(m["start"] < at, F.lit("")).otherwise(F.concat(part(at, m["start"]), F.lit(mark))))
        return F.concat(F.array_join(kept, ""), part(F.array_max(ends), F.octet_length(wide)))

    # four bytes a code point: a part is found by its place, however long the text is
    text = F.col(text_col).cast("string")
    found = let(F.struct(text.alias("t"), let(text, lambda t: spans(t, allow)).alias("s")), lambda x: F.when(F.size(x["s"]) == 0, x["t"]).otherwise(
        let(F.struct(F.encode(x["t"], "UTF-32").alias("w"), x["s"].alias("s")), cut)))
    return docs.withColumn(text_col, F.when(text.isNull(), text).otherwise(found))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op4."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
