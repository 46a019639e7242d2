"""A log of note edits with undo and redo.

The log only grows. A row is an entry of a session: edit, undo or redo, by number. What an entry does depends on the
stacks that those before it left, so entries stream in order and carry the stacks along. Which edits are in force after
an entry then comes from aggregates, and the notes from the last change in force of each, by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Entries that can be undone at most.
LIMIT = 100


def resolve(log: DataFrame, by: list[str], limit: int = LIMIT) -> DataFrame:
    """log (by, entry, kind) with edit: the number of the edit that the entry carries out (an edit its own), takes back or brings back; null if there is nothing to.

    An edit goes on the undo stack, which drops its oldest beyond limit, and clears the redo stack; undo and redo move
    the top of one stack to the other. Sessions stream, sorted by entry, through the tasks they hash to; a task holds
    the stacks of one session, at most limit numbers, so a long session needs no more memory than a short one. Kinds
    other than the three carry out nothing.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    dealt = log.repartition(*by).sortWithinPartitions(*by, "entry")
    keys, entry, kind = [log.columns.index(c) for c in by], log.columns.index("entry"), log.columns.index("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, undo, redo = None, [], []
        for batch in batches:
            out: list[int | None] = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, entry, kind)), strict=True):
                if at != row[:-2]:
                    at, undo, redo = row[:-2], [], []
                no, what, edit = row[-2], row[-1], None
                if what == "edit":
                    undo.append(no)
                    del undo[:-limit]
                    redo, edit = [], no
                elif what == "undo" and undo:
                    edit = undo.pop()
                    redo.append(edit)
                elif what == "redo" and redo:
                    edit = redo.pop()
                    undo.append(edit)
                out.append(edit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "edit"])

    return dealt.mapInArrow(run, T.StructType([*log.schema.fields, T.StructField("edit", T.LongType())]))


def live_edits(resolved: DataFrame, by: list[str], versions: DataFrame | None = None) -> DataFrame:
    """(by, edit) of the edits in force after the last entry, or after the entry of each session that versions (by, version) names: those whose last mention up to there is no undo.

    An edit that fell off the undo stack stays in force.
    """
    r = resolved.where("edit is not null")
    if versions is not None:
        r = r.join(versions, by).where("entry <= version")
    last = r.groupBy(*by, "edit").agg(F.max_by("kind", "entry").alias("kind"))
    return last.where("kind <> 'undo'").select(*by, "edit")


def notes_at(base: DataFrame, changes: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """base (by, note_id, ...) with the changes of the live edits.

    changes: by, edit, note_id, gone and the other columns of base, the note as the edit leaves it, or gone. The change
    of the latest live edit of a note counts; edits of one note come after each other, so that is the state that taking
    edits back one by one leads to.
    """
    values = base.columns
    of = changes.join(live, [*by, "edit"])
    top = of.groupBy(*by, "note_id").agg(F.max_by(F.struct("gone", *[c for c in values if c not in (*by, "note_id")]), "edit").alias("x"))
    kept = base.join(top, [*by, "note_id"], "left_anti")
    return kept.unionByName(top.where("not x.gone").select(*by, "note_id", "x.*").select(*values))


def depth(resolved: DataFrame, by: list[str]) -> DataFrame:
    """(by, entry, undoable): how many entries could be undone after each, from running sums; without the limit's cut, for sessions that stay below it."""
    move = F.when(F.col("edit").isNull(), 0).when(F.col("kind") == "undo", -1).otherwise(1)
    w = Window.partitionBy(*by).orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    return resolved.select(*by, "entry", F.sum(move).over(w).alias("undoable"))
