"""One whole link pass: notes, symbols and files in, every table of its outcome out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from ..operators import references as R
from ..operators import resolve as V
from ..operators import rollups as U
from .tables import stored


@dataclass(frozen=True)
class LinkOptions:
    min_len: int = R.DEFAULT_MIN_LEN
    max_links: int = V.DEFAULT_MAX_LINKS
    stopwords: tuple[str, ...] = rx.STOPWORDS


@dataclass
class Linked:
    """notes (note, body, overrides, ...), decisions, resolved files, links, anchors, withheld, unlinked; the symbols that it stands on."""

    notes: DataFrame
    decisions: DataFrame
    resolved: DataFrame
    links: DataFrame
    anchors: DataFrame
    withheld: DataFrame
    unlinked: DataFrame
    symbols: DataFrame

    def ambiguous_refs(self) -> DataFrame:
        return U.ambiguous_refs(self.withheld, V.candidates(self.withheld, self.symbols, self.resolved))

    def metrics(self, skipped: DataFrame | None = None) -> DataFrame:
        return U.link_metrics(self.notes, self.links, self.anchors, self.withheld, self.unlinked, skipped)


def decide(notes: DataFrame, symbols: DataFrame, options: LinkOptions = LinkOptions()) -> DataFrame:
    """The decisions, stored: a filter on them must not be pushed into their computation."""
    refs = R.symbol_refs(notes, symbols, options.min_len, options.stopwords)
    return stored(V.resolve(refs, notes, symbols), "decisions")


def link(notes: DataFrame, symbols: DataFrame, files: DataFrame, options: LinkOptions = LinkOptions()) -> Linked:
    """files: (path, basename), see repo_files."""
    return outcome(notes, symbols, decide(notes, symbols, options), resolve_all(notes, files), options)


def resolve_all(notes: DataFrame, files: DataFrame) -> DataFrame:
    """The notes' file references with their matches, stored: notes are parsed for them once."""
    return stored(R.resolve_files(stored(R.file_refs(notes), "refs"), files), "resolved")


def outcome(notes: DataFrame, symbols: DataFrame, decisions: DataFrame, resolved: DataFrame, options: LinkOptions) -> Linked:
    """decisions and resolved: stored tables; they are read for each of the outcome's tables."""
    links = stored(V.cap_links(decisions, options.max_links), "linked")
    anchors = V.cap_anchors(resolved, links, options.max_links)
    withheld = V.ambiguous(decisions, resolved)
    bare = V.unlinked(notes, links, anchors, withheld, symbols)
    return Linked(notes, decisions, resolved, links, anchors, withheld, bare, symbols)


def located(links: DataFrame) -> DataFrame:
    """Links with their formatted destination, for reports."""
    from ..functions import columns as C

    return links.select("note", "name", F.concat_ws("/", "evidence", "reason").alias("why"), C.location(F.col("path"), F.col("line")).alias("destination"))
