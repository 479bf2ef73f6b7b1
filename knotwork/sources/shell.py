"""A small language over matrix files: LOAD, SAVE, FORMAT, CONVERT, MULTIPLY, PRINT and EXIT, each ended by ``;``.

    LOAD "a.mtx" "mtx" AS A; CONVERT A "rows"; FORMAT A; MULTIPLY A A AS B; SAVE B "out"; PRINT B; EXIT;
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import matrix
from knotwork.sources import formats

_WORD = re.compile(r'"([^"]*)"|(\S+)')


@dataclass
class Shell:
    spark: SparkSession
    held: dict[str, DataFrame] = field(default_factory=dict)
    layout: dict[str, str] = field(default_factory=dict)

    def run(self, text: str) -> list[str]:
        """What the statements print."""
        out: list[str] = []
        for statement in text.split(";"):
            words = [a or b for a, b in _WORD.findall(statement)]
            if not words:
                continue
            verb = words[0].upper()
            if verb == "EXIT":
                break
            if verb == "LOAD":
                name = words[4] if len(words) > 4 else "A"
                self.held[name], self.layout[name] = formats.load(self.spark, words[1], words[2]), "triples"
            elif verb == "SAVE":
                a = self._triples(words[1])
                size = a.agg(F.max("row"), F.max("col")).first()
                formats.write_matrix_market(a, words[2], size[0] or 0, size[1] or 0)
            elif verb == "FORMAT":
                out.append(self.layout[words[1]])
            elif verb == "CONVERT":
                a = self._triples(words[1])
                self.held[words[1]] = {"triples": lambda: a, "rows": lambda: matrix.rows_as_lists(a), "columns": lambda: matrix.rows_as_lists(matrix.transpose(a))}[words[2]]()
                self.layout[words[1]] = words[2]
            elif verb == "MULTIPLY":
                self.held[words[4]], self.layout[words[4]] = matrix.multiply(self._triples(words[1]), self._triples(words[2])), "triples"
            elif verb == "PRINT":
                out += [f"{r['row']} {r['col']} {r['val']}" for r in self._triples(words[1]).orderBy("row", "col").limit(100).collect()]
            else:
                raise ValueError(f"no statement {words[0]}")
        return out

    def _triples(self, name: str) -> DataFrame:
        a, layout = self.held[name], self.layout[name]
        if layout == "triples":
            return a
        back = matrix.lists_as_rows(a)
        return back if layout == "rows" else matrix.transpose(back)
