"""The nearest node around each node of a tree, by one ordered pass over nested ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_around(nodes: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """(fn_id, node_id, around): for each node of a kind in `wanted`, the innermost node that holds it
    (itself included) and is of one of the kinds that `wanted` names; itself if there is none.

    Nodes come in preorder with the last node of their range. One pass keeps a stack of open nodes
    for each kind that counts; a node is pushed once and popped once, so work grows with the nodes,
    however deep they nest, and a batch boundary inside a function does not matter.
    """
    kinds = sorted({k for names in wanted.values() for k in names})
    rows = nodes.filter(F.col("type").isin(*{*kinds, *wanted})).select("fn_id", "node_id", "last_id", "type")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stacks = None, {}
        for b in batches:
            out = []
            for fn, node, last, kind in zip(b["fn_id"].tolist(), b["node_id"].tolist(), b["last_id"].tolist(), b["type"].tolist()):
                if fn != now:
                    now, stacks = fn, {k: [] for k in kinds}
                if kind in stacks:
                    stacks[kind].append((node, last))
                if kind in wanted:
                    best = -1
                    for k in wanted[kind]:
                        held = stacks[k]
                        while held and held[-1][1] < node:
                            held.pop()
                        if held:
                            best = max(best, held[-1][0])
                    out.append((fn, node, best if best >= 0 else node))
            yield pd.DataFrame(out, columns=["fn_id", "node_id", "around"])

    kind_of = dict(nodes.dtypes)
    dealt = rows.repartition("fn_id").sortWithinPartitions("fn_id", "node_id")
    return dealt.mapInPandas(run, f"fn_id {kind_of['fn_id']}, node_id {kind_of['node_id']}, around {kind_of['node_id']}")
