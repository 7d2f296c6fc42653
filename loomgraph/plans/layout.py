"""The layout run: forces, speed, update, again and again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.approx import THETA, repulsion_approx
from ..operators.forces import Speed, attraction, gravity, next_speed, repulsion_exact, swing_traction, total_force, update_nodes
from ..sources.shared import discard, written
from .adjacency import LaidOut, lay_out


@dataclass(frozen=True)
class LayoutParams:
    attraction: float = 1.0
    weight_power: float = 1.0
    repulsion: float = 1.0
    soft: float = 0.05**2
    gravity: float = 1.0
    strong_gravity: bool = True
    theta: float = THETA


def layout_step(nodes: DataFrame, adj: DataFrame | LaidOut, params: LayoutParams, state: Speed, repulsion: str = "exact") -> tuple[DataFrame, Speed, dict]:
    """One step. The forces are written once; one row of sums reaches the driver. Edges that
    were laid out stay where they are."""
    push = (
        repulsion_exact(nodes, params.repulsion, params.soft)
        if repulsion == "exact"
        else repulsion_approx(nodes, params.repulsion, params.soft, params.theta)
    )
    edges, there = (adj.edges, adj.placed(nodes)) if isinstance(adj, LaidOut) else (adj, None)
    forces = total_force(
        attraction(nodes, edges, params.attraction, params.weight_power, there), gravity(nodes, params.gravity, params.strong_gravity), push
    )
    forced = written(nodes.join(forces, "node_id", "left").fillna(0.0, ["fx", "fy"]), "layout-forces")
    row = swing_traction(forced).first()
    state = next_speed(state, row["swing"] or 0.0, row["traction"] or 0.0, row["n"])
    moved = written(update_nodes(forced, state.speed), "layout-nodes")
    discard(forced, push)
    return moved, state, {"swing": row["swing"], "traction": row["traction"], "speed": state.speed, "efficiency": state.efficiency}


def layout(nodes: DataFrame, adj: DataFrame, iterations: int, params: LayoutParams | None = None, repulsion: str = "exact", state: Speed | None = None) -> tuple[DataFrame, list[dict]]:
    """Nodes (node_id, mass, x, y and more) after so many steps, and the history of the
    controller. ``adj`` holds every edge in both directions."""
    params, state = params or LayoutParams(), state or Speed()
    nodes = written(nodes.withColumns({"fx_prev": F.lit(0.0), "fy_prev": F.lit(0.0)}), "layout-nodes")
    laid = lay_out(adj)
    history = []
    for k in range(iterations):
        before = nodes
        nodes, state, row = layout_step(nodes, laid, params, state, repulsion)
        discard(before)
        history.append({"iteration": k, **row})
    laid.drop()
    return nodes, history
