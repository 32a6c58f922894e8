"""Input size classification of a phrase.

Token count = number of whitespace-separated pieces, character count = code
points; group ``1_token`` for one token, ``2_4_tokens`` for up to four (zero
tokens fall here too), ``5_8_tokens``, ``9_15_tokens``, else
``16_plus_tokens``; flag for more than 90 characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.text import WS_RUN

# Size group labels and their upper token bounds.
GROUPS = (("1_token", 1), ("2_4_tokens", 4), ("5_8_tokens", 8), ("9_15_tokens", 15))
LAST_GROUP = "16_plus_tokens"
LONG_INPUT_CHARS = 90


def token_count(phrase: Column) -> Column:
    return F.size(F.filter(F.split(phrase, WS_RUN), lambda piece: piece != ""))


def size_group(count: Column) -> Column:
    expr = F.when(count == 1, GROUPS[0][0])
    for label, bound in GROUPS[1:]:
        expr = expr.when(count <= bound, label)
    return expr.otherwise(LAST_GROUP)


def input_size(phrase: Column) -> Column:
    """struct<token_count, char_count, group, over_90_chars>."""
    count = token_count(phrase)
    chars = F.length(phrase)
    return F.struct(count.alias("token_count"), chars.alias("char_count"), size_group(count).alias("group"),
                    (chars > LONG_INPUT_CHARS).alias("over_90_chars"))
