"""The mixture that the query and the pipeline share."""

from pyspark.sql import DataFrame, functions as F

from headwise.llm import mixing

# The recipe: a target weight per named source, and one for all other sources together.
MIX_WEIGHTS = {"src0": 16.0, "src1": 9.0, "src2": 9.0, "src3": 7.0, "src4": 7.0, "src5": 5.0, "src6": 5.0, "src7": 3.0}
MIX_REST = 39.0
MIX_BLOCK = 8192
MIX_RESOLUTION = 100


def mixed(docs: DataFrame) -> DataFrame:
    """Mixed by characters in blocks of 8,192."""
    return mixing.mix(
        docs, MIX_WEIGHTS, MIX_REST, size=F.char_length("text"), block=MIX_BLOCK, resolution=MIX_RESOLUTION
    )
