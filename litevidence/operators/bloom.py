"""Bloom filters as small tables, tested in the stage that scans the rows.

A filter is a table of 64-bit words. A key sets a few bits of one word, so testing a key is one look-up in a broadcast
table and one comparison, all in built-in expressions. A filter lets every member pass and few others; the exact
join comes after it. It pays where the keys are too many to broadcast but choose few of the rows, as rows without a chance
go before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litevidence.sources.writers import staged

BITS = 4               # bits that a key sets in its word
KEYS_PER_WORD = 4      # keys that share a word, on average: about one other key in a hundred passes
MAX_WORDS = 1 << 20    # words of a filter, and so rows that are broadcast; beyond it words get fuller and more keys pass


@dataclass(frozen=True)
class Bloom:
    table: DataFrame   # _word, _bits
    words: int

    def possible(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose key may be a member. Rows without the key are none."""
        key = rows[column].cast("string")
        # As a semi-join, since the optimiser would move the exact semi-join below an inner one.
        met = (_word(key, self.words) == self.table["_word"]) & (self.table["_bits"].bitwiseAND(_mask(key)) == _mask(key))
        return rows.where(key.isNotNull()).join(F.broadcast(self.table), met, "left_semi")


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _mask(key: Column) -> Column:
    """The bits of a key: six bits of a second hash choose each."""
    second = F.xxhash64(F.lit("bits"), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    return reduce(Column.bitwiseOR, bits)


def bloom_filter(keys: DataFrame, column: str, max_words: int = MAX_WORDS) -> Bloom:
    """The filter of the non-null keys of a written table; it is counted once and read once.

    Bits are joined before the shuffle, so no more than `max_words` rows of any task meet. Copies do no harm.
    """
    key = F.col(column).cast("string")
    known = keys.where(key.isNotNull())
    words = max(1, min(max_words, -(-known.count() // KEYS_PER_WORD)))
    table = known.groupBy(_word(key, words).alias("_word")).agg(F.bit_or(_mask(key)).alias("_bits"))
    return Bloom(staged(table, "bloom"), words)
