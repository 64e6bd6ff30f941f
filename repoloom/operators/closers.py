"""Ends of functions from one pass per file, from the last signature to the first.

A signature whose own text (up to the next signature of its kind) doesn't hold its end would otherwise be
scanned to wherever that is, each signature anew: on code without semicolons to the end of the file, for
functions around others over all that is inside. Here every piece of text between signatures is read once and summed up:

* how many blocks it leaves open, and where it closes blocks that were opened before it,
* its first `;`,
* whether it ends outside strings and comments, so that reading on from there is reading afresh.

Walking from the last piece to the first, the closers of all text to the right are known as a list, the nearest
first: a piece takes off as many as it leaves open and puts its own in front. A block that is open `d` levels deep
at the end of its piece ends at the d-th closer to the right, an expression at the next `;`. Where a piece ends inside a
string or comment, what lies beyond it is unknown and the exact scan answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.rowscan import let, scan
from repoloom.operators.lexing import END, tokens

#: Answers besides positions: the function has no end; this pass can't tell.
NO_END, UNKNOWN = -1, -2
ANSWER = "struct<nth:int,e:int>"


def _ints() -> Column:
    return F.array().cast("array<int>")


def summary(piece: Column, dialect: str) -> Column:
    """struct(opens, closes, semi, first) of a piece read from outside strings and comments.

    `opens` blocks are open at its end; `closes` are the ends of closers without an opener in the piece; `semi`
    is behind the first `;`, `first` behind the closer that brings the depth back to 0 first (0 = none)."""

    def step(acc: Column, token: Column) -> Column:
        mark, after = F.right(token, F.lit(1)), acc["off"] + F.length(token)
        ends = mark == END
        if dialect == "lua":  # words: function if for while repeat; until end
            closer = mark.isin("d", "l")
            opener = ~closer & ~ends
        else:
            opener, closer = mark == "{", mark == "}"
        back = closer & (acc["opens"] > 0)
        return F.struct(
            after.alias("off"),
            F.when(opener, acc["opens"] + 1).when(back, acc["opens"] - 1).otherwise(acc["opens"]).alias("opens"),
            F.when(closer & (acc["opens"] == 0), F.concat(acc["closes"], F.array(after))).otherwise(acc["closes"]).alias("closes"),
            F.when((mark == ";") & (acc["semi"] == 0), after).otherwise(acc["semi"]).alias("semi"),
            F.when(back & (acc["opens"] == 1) & (acc["first"] == 0), after).otherwise(acc["first"]).alias("first"),
        )

    zero = F.lit(0)
    start = F.struct(zero.alias("off"), zero.alias("opens"), _ints().alias("closes"), zero.alias("semi"), zero.alias("first"))
    return F.aggregate(tokens(piece, dialect), start, step)


def ends_of_rule(length: Column, asked: Column, dialect: str, patterns: dict[str, str]) -> Column:
    """ANSWER for every entry of `asked`, an array of struct(nth, want, s) of one rule in order of position; `length` of the text.

    `patterns`: `closed` a text that ends outside strings and comments, `opening` a signature up to
    where its block opens, `expression` a signature whose expression goes on to the end of the text."""

    def summed(it: Column) -> Column:
        s = it["s"]
        shift = s["brace"] - s["idx"]
        own = F.substring(s["piece"], shift + 1, F.length(s["piece"]))
        before = F.length(F.regexp_extract(own, patterns["opening"], 0)) if patterns["opening"] else F.lit(0)
        goes_on = own.rlike(patterns["expression"]) if patterns["expression"] else F.lit(False)
        opens = (before > 0) if patterns["opening"] else F.lit(True)
        kind = F.when(~it["want"], 0).when(goes_on, 2).when(opens, 1).otherwise(3)

        def with_block(n: Column) -> Column:
            # the piece itself, and what of it is asked about
            parts = F.array(s["piece"], F.substring(own, n + 1, F.length(own)))
            read = F.transform(
                F.slice(parts, 1, F.when(kind == 1, 2).otherwise(1)),
                lambda p: F.struct(p.rlike(patterns["closed"]).alias("closed"), summary(p, dialect).alias("sum")),
            )
            return F.struct(
                it["nth"].alias("nth"),
                kind.alias("kind"),
                s["idx"].alias("idx"),
                (s["idx"] + F.length(s["piece"])).alias("end"),
                (s["brace"] + n).alias("at"),
                read.alias("read"),
            )

        return let(before, with_block)

    def answer(it: Column, right: Column) -> Column:
        """The end asked for, given what is known of the text to the right."""

        def of_block(block: Column) -> Column:
            depth = block["sum"]["opens"]
            return (
                F.when(block["sum"]["first"] > 0, it["at"] + block["sum"]["first"])
                .when(right["last"], NO_END)
                .when(~block["closed"], UNKNOWN)
                .when(F.size(right["closers"]) >= depth, F.get(right["closers"], depth - 1))
                .when(right["whole"], NO_END)
                .otherwise(UNKNOWN)
            )

        block = let(F.get(it["read"], F.lit(1)), of_block)
        return F.when(it["kind"] == 1, block).when(it["kind"] == 2, right["semi"]).otherwise(UNKNOWN)

    def step(acc: Column, it: Column) -> Column:
        beside = it["end"] == acc["next"]
        last = it["end"] == length
        right = F.struct(
            last.alias("last"),
            F.when(beside, acc["closers"]).otherwise(_ints()).alias("closers"),
            (last | (beside & acc["whole"])).alias("whole"),
            F.when(last, NO_END).when(beside, acc["semi"]).otherwise(UNKNOWN).alias("semi"),
        )

        def joined(right: Column) -> Column:
            def after(own: Column) -> Column:
                left = F.slice(right["closers"], own["sum"]["opens"] + 1, F.size(right["closers"]))
                closers = F.transform(own["sum"]["closes"], lambda c: c + it["idx"])
                return F.struct(
                    it["idx"].alias("next"),
                    F.when(own["closed"], F.concat(closers, left)).otherwise(closers).alias("closers"),
                    (right["last"] | (own["closed"] & right["whole"])).alias("whole"),
                    F.when(own["sum"]["semi"] > 0, it["idx"] + own["sum"]["semi"])
                    .when(right["last"] | own["closed"], right["semi"])
                    .otherwise(UNKNOWN)
                    .alias("semi"),
                    F.array(F.struct(it["nth"].alias("nth"), answer(it, right).alias("e"))).alias("out"),
                )

            return let(F.get(it["read"], F.lit(0)), after)

        return let(right, joined)

    state = {"next": F.lit(-1), "closers": _ints(), "whole": F.lit(True), "semi": F.lit(NO_END)}
    return scan(F.reverse(F.transform(asked, summed)), state, ANSWER, step)


def ends(text: Column, sigs: Column, want: Column, dialect: str, rules: tuple[str, ...], patterns: dict[str, str]) -> Column:
    """For each signature the end found, NO_END or UNKNOWN; `want` says which are asked about."""
    entries = F.transform(sigs, lambda s, i: F.struct(i.alias("nth"), F.get(want, i).alias("want"), s.alias("s")))

    def of_rule(length: Column, all_entries: Column, rule: Column) -> Column:
        def found(mine: Column) -> Column:
            nothing = F.transform(mine, lambda e: F.struct(e["nth"].alias("nth"), F.lit(UNKNOWN).alias("e")))
            return F.when(F.exists(mine, lambda e: e["want"]), ends_of_rule(length, mine, dialect, patterns)).otherwise(nothing)

        return let(F.filter(all_entries, lambda e: e["s"]["rule"] == rule), found)

    each = F.array(*[F.lit(r) for r in rules])
    found = let(F.length(text), lambda n: let(entries, lambda a: F.flatten(F.transform(each, lambda r: of_rule(n, a, r)))))
    return F.transform(F.array_sort(found), lambda a: a["e"])
