"""Codemaps as text: an outline by module, and a Mermaid flow chart."""

from __future__ import annotations

import re
from collections.abc import Iterable

MAX_RENDERED = 500


def _parent(item: str) -> str:
    return item.rpartition("::")[0] or "_orphans"


def _node_id(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


def outline(nodes: Iterable[tuple[str, int, float]], edges: Iterable[tuple[str, str, str]]) -> str:
    """nodes: item, distance, score, at most 500; edges: caller, callee, kind."""
    groups: dict[str, list] = {}
    for n in sorted(nodes, key=lambda n: (-n[2], n[0]))[:MAX_RENDERED]:
        groups.setdefault(_parent(n[0]), []).append(n)
    out: dict[str, list] = {}
    for a, b, kind in sorted(edges):
        out.setdefault(a, []).append((b, kind))
    text = []
    for g in sorted(groups):
        text.append(g)
        for item, distance, score in groups[g]:
            text.append(f"  {item.rpartition('::')[2]} [{score:.2f}]" + (" (seed)" if distance == 0 else ""))
            text += [f"    {kind.lower()} {b}" for b, kind in out.get(item, ())]
    return "\n".join(text)


def mermaid(nodes: Iterable[tuple[str, int, float]], edges: Iterable[tuple[str, str, str]]) -> str:
    nodes = sorted(nodes, key=lambda n: (-n[2], n[0]))[:MAX_RENDERED]
    shown = {n[0] for n in nodes}
    groups: dict[str, list] = {}
    for n in nodes:
        groups.setdefault(_parent(n[0]), []).append(n)
    text = ["flowchart LR"]
    for g in sorted(groups):
        text.append(f'  subgraph {_node_id(g)}["{g}"]')
        for item, distance, _ in sorted(groups[g]):
            label = item.rpartition("::")[2].replace('"', "#quot;")
            text.append(f'    {_node_id(item)}["{label}"]' + (":::seed" if distance == 0 else ""))
        text.append("  end")
    text += [f"  {_node_id(a)} {'-->' if kind == 'Calls' else '-.->'} {_node_id(b)}" for a, b, kind in sorted(edges) if a in shown and b in shown]
    return "\n".join([*text, "  classDef seed stroke-width:3px"])
