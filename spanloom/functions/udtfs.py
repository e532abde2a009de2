"""Table functions for SQL: scans of C, tokens, call arguments, Makefile inputs. They are for queries written in SQL; plans use the Arrow passes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from spanloom.functions.values import whole_tokens
from spanloom.operators import cbody, csource
from spanloom.sources import makefile


@udtf(returnType="what string, name string, line int, end_line int, detail string")
class CScan:
    """Includes, macros, definitions and calls of a C text; none for null."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from csource.scan(text) if text is not None else ()


@udtf(returnType="position int, token string")
class Tokens:
    """The retrieval tokens of a text in order."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(whole_tokens(text), 1)


@udtf(returnType=cbody.ARGUMENTS)
class CArguments:
    """The arguments of the calls in a C text's functions."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from cbody.every_argument(text) if text is not None else ()


@udtf(returnType="what string, value string")
class MakeInputs:
    """Sources, folders and flags that a Makefile's text names."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for what, values in makefile.build_inputs(text).items():
                for v in values:
                    yield what, v


TABLE_FUNCTIONS = {"c_scan": CScan, "retrieval_tokens": Tokens, "c_arguments": CArguments, "make_inputs": MakeInputs}


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL by the names of ``TABLE_FUNCTIONS``."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
