"""Text representations of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

TAGS, PATHS, TEXTS, CLIP, SOURCE = 20, 25, 10, 40, 4000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def code_rep() -> Column:
    """What a component is called, takes and does, one kind a line."""
    u = lambda c: text.unique(F.col(c))
    props = F.concat(u("prop_names"), F.when(F.coalesce(F.col("spreads"), F.lit(0)) > 0, F.array(F.concat(F.lit("..."), F.col("spreads").cast("string")))).otherwise(F.array().cast("array<string>")))
    return F.concat_ws(
        "\n",
        _line("COMPONENT", F.col("name")),
        _line("PROPS", text.or_none(props, ", ")),
        _line("HOOKS", text.or_none(u("hooks"), ", ")),
        _line("LOGIC", text.or_none(u("logic"), ", ")),
        _line("JSX", text.or_none(F.slice(text.present(F.col("tags")), 1, TAGS), " -> ")),
        _line("CLASSES", text.or_none(u("classes"), " ")),
        _line("LITERALS", text.or_none(u("literals"), ", ")),
    )


def structure_rep(paths: Column, texts: Column, classes: Column) -> Column:
    shown = F.transform(F.slice(text.unique(paths), 1, PATHS), text.short_path)
    said = F.transform(F.slice(text.unique(texts), 1, TEXTS), lambda x: text.clip(x, CLIP))
    return F.concat_ws("\n", _line("PATHS", text.or_none(shown, " | ")), _line("TEXT", text.or_none(said, " | ")), _line("CLASSES", text.or_none(text.unique(classes), " ")))


def holistic_rep(name: Column, structure: Column, code: Column, style: Column, source: Column) -> Column:
    """All of it on one line; style and source only where there are any."""
    src = text.normalize(F.substring(source, 1, SOURCE))
    some = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", _line(n, c))
    return text.normalize(F.concat_ws("\n", _line("NAME", name), _line("STRUCTURE", structure), _line("CODE", code), some("STYLE", style), some("SOURCE", src)))


def represented(components: DataFrame) -> DataFrame:
    """Adds code_rep, style_rep, structure_rep and holistic_rep; components has style_text, paths and the feature lists."""
    out = components.withColumn("code_rep", code_rep()).withColumn("style_rep", F.coalesce("style_text", F.lit("")))
    out = out.withColumn("structure_rep", structure_rep(F.col("paths"), F.col("texts"), F.col("classes")))
    return out.withColumn("holistic_rep", holistic_rep(F.col("name"), F.col("structure_rep"), F.col("code_rep"), F.col("style_rep"), F.col("source")))
