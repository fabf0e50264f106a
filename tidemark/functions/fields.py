"""Reading fields of a JSON text column without coercing anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


class JsonFields:
    """The fields of one JSON object column, each looked up once.

    The text is parsed in one projection, the fields are found in the next, and their kinds and
    texts are taken in a third, so checks that mention a field several times do not parse the
    text or look the field up again.  A field that is not there has no kind; null has ``VOID``.
    """

    def __init__(self, df: DataFrame, column: str, names: Sequence[str]) -> None:
        self.names = list(names)
        parsed = df.withColumn("_whole", F.try_parse_json(column))
        held = {f"_v_{name}": F.try_variant_get("_whole", f"$.{name}", "variant") for name in self.names}
        found = {"_kind": F.schema_of_variant("_whole")}
        for name in self.names:
            found[f"_k_{name}"] = F.schema_of_variant(f"_v_{name}")
            found[f"_t_{name}"] = F.try_variant_get(f"_v_{name}", "$", "string")
        self.df = parsed.withColumns(held).withColumns(found)
        self.helpers = ["_whole", *held, *found]

    def kind(self, name: str) -> Column:
        return F.col(f"_k_{name}")

    def text(self, name: str) -> Column:
        return F.col(f"_t_{name}")

    def missing(self, name: str) -> Column:
        return self.kind(name).isNull()

    def not_text(self, name: str) -> Column:
        return ~F.coalesce((self.kind(name) == "STRING") & (self.text(name) != ""), F.lit(False))

    def not_number(self, name: str, pattern: str) -> Column:
        """Exact numbers arrive as text of the given form or as JSON integers."""
        exact = self.kind(name).isin("STRING", "BIGINT") & self.text(name).rlike(pattern)
        return ~F.coalesce(exact, F.lit(False))

    def exact(self, name: str) -> Column:
        """The number with eight decimals, NULL when it does not fit without rounding."""
        rounded = F.coalesce(self.text(name).rlike(r"\.[0-9]{8}[0-9]*[1-9]"), F.lit(False))
        return F.when(~rounded, self.text(name).try_cast("decimal(28,8)"))

    def whole(self, name: str) -> Column:
        """The whole number, NULL when it does not fit 64 bits."""
        return F.when(self.text(name).rlike(r"^-?[0-9]+$"), self.text(name).try_cast("bigint"))

    def time(self, name: str) -> Column:
        return self.text(name).try_cast("timestamp")

    def not_time(self, name: str, pattern: str) -> Column:
        ok = (self.kind(name) == "STRING") & self.text(name).rlike(pattern) & self.time(name).isNotNull()
        return ~F.coalesce(ok, F.lit(False))
