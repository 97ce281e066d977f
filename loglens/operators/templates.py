"""Templates of messages: words with digits masked, then a search tree over masked templates.

Lines are reduced to distinct masked templates with their counts by a grouped count, which is small beside the log.
Drain's tree (He et al., ICWS 2017) needs the order of its input only to break ties; here templates of one length and
first word are clustered together, the most frequent first, and are spread over tasks by that key.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WILDCARD, SIMILARITY, MOST = "<*>", 0.4, 200


def masked(lines: DataFrame, text: str = "line") -> DataFrame:
    """template and n: words that hold a digit become the wildcard; blank lines are left out."""
    words = F.split(F.trim(F.col(text)), r"\s+")
    template = F.array_join(F.transform(words, lambda w: F.when(w.rlike("[0-9]"), WILDCARD).otherwise(w)), " ")
    return lines.filter(F.trim(F.col(text)) != "").groupBy(template.alias("template")).agg(F.count("*").alias("n"))


def similar(a: list[str], b: list[str]) -> float:
    return sum(x == y and x != WILDCARD for x, y in zip(a, b, strict=True)) / len(a)


def clustered(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """template and n, templates alike merged with wildcards where they differ."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for template, n in sorted(zip(part["template"], part["n"], strict=True), key=lambda x: (-x[1], x[0])):
            words = template.split(" ")
            best = max(groups, key=lambda g: similar(g[0], words), default=None)
            if best is not None and similar(best[0], words) >= similarity:
                best[0] = [x if x == y else WILDCARD for x, y in zip(best[0], words, strict=True)]
                best[1] += n
            else:
                groups.append([words, n])
        return pd.DataFrame({"template": [" ".join(w) for w, _ in groups], "n": [n for _, n in groups]}, columns=["template", "n"])

    words = F.split("template", " ")
    keyed = found.withColumns({"size": F.size(words), "first": F.element_at(words, 1)})
    return keyed.groupBy("size", "first").applyInPandas(run, "template string, n long").groupBy("template").agg(F.sum("n").alias("n"))


def top(found: DataFrame, most: int = MOST) -> DataFrame:
    """The most frequent templates (a top-k report)."""
    return found.orderBy(F.desc("n"), "template").limit(most)
