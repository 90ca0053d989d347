"""Artist and album indexes and collection totals that new tracks are added to.

A run of tracks leaves partial states: for every (slug, name, member) its count and its first
and last place, and one row of sums. Indexes and totals come from the states of all runs, so
the tracks of earlier runs are not read again, and equal those of a rebuild over all tracks
row for row, in whatever order runs come.

A run counts from its commit on; one that fails before leaves what it had been. Adding the same
tracks twice counts them twice: dedup is the task of ``incremental.Runs``. Runs without
rows add nothing; without any run there is no index and no total (``None``). Null slugs form
an entity of their own, as in a rebuild, and are left out of the distinct counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalogforge.operators import entities
from catalogforge.operators.incremental import Commits

# Slug, name, member and the column that counts members, of each kind of entity.
KINDS = {
    "artists": ("artistSlug", "artist", "album", "albumCount"),
    "albums": ("albumSlug", "album", "artist", "artistCount"),
}


class Maintained(Commits):
    """The states below a folder."""

    def add(self, tracks: DataFrame, order: str = "seq") -> int:
        """Adds ``tracks`` and returns the number of the run.

        ``tracks`` is scanned once for each state, so it should be a stored table.
        """
        run = self.next_run()
        states = {kind: entities.entity_state(tracks, *columns[:3], order) for kind, columns in KINDS.items()}
        return self._write(run, states | {"totals": entities.totals_state(tracks)})

    def _write(self, run: int, states: dict[str, DataFrame]) -> int:
        for name, state in states.items():
            # What a run of this number left before it failed is named by nothing.
            state.write.mode("overwrite").parquet(f"{self.out}/run={run}/{name}")
        self._commit(run)
        return run

    def index(self, kind: str) -> DataFrame | None:
        """The artist or album index over all runs."""
        states = self.table(kind)
        if states is None:
            return None
        return entities.numbered_summary(entities.summary_of_states(states, *KINDS[kind]))

    def members(self, kind: str) -> DataFrame | None:
        """``entities.entity_members`` over all runs."""
        states = self.table(kind)
        slug, _, member, _ = KINDS[kind]
        return None if states is None else entities.entity_members(states, slug, member)

    def stats(self) -> DataFrame | None:
        """``entities.collection_stats`` over all runs."""
        totals, artists, albums = (self.table(name) for name in ("totals", *KINDS))
        if totals is None or artists is None or albums is None:
            return None
        return entities.stats_of_states(totals, artists, albums)

    def compacted(self, out: str) -> Maintained:
        """The states of all runs merged into one run of an empty folder ``out``."""
        into = Maintained(self.spark, out)
        if into.committed():
            raise ValueError(f"{out} holds runs already")
        merged = {}
        for kind, columns in KINDS.items():
            states = self.table(kind)
            if states is None:
                return into
            merged[kind] = entities.merged_states(states, *columns[:3])
        totals = self.table("totals")
        into._write(0, merged if totals is None else merged | {"totals": totals.coalesce(1)})
        return into
