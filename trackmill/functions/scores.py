"""Scores of matching observations to arcs, as column expressions; constants are a profile's values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import wrapped


@dataclass(frozen=True)
class Profile:
    """Fixed values of the matching profile."""

    radius_least: float = 5.0
    radius_usual: float = 15.0
    radius_most: float = 75.0
    radius_sigmas: float = 3.0
    sigma_least: float = 4.0
    sigma_most: float = 30.0
    heading_sigma: float = 0.5236
    heading_from: float = 1.0
    heading_full: float = 3.0
    off_map: float = -5.0
    distance_scale: float = 20.0
    top_speed: float = 60.0
    speed_allowance: float = 15.0
    speed_cost: float = 0.25
    turn_cost: float = 0.2
    u_turn_cost: float = 2.0
    off_map_change: float = -2.5
    off_map_stay: float = -1.0


PROFILE = Profile()


def gauss(residual: Column, sigma: Column) -> Column:
    """The log density of a normal residual."""
    return -0.5 * (residual / sigma) * (residual / sigma) - F.log(sigma) - 0.5 * math.log(2 * math.pi)


def search_radius(uncertainty: Column, p: Profile = PROFILE) -> Column:
    wide = F.greatest(F.lit(p.radius_usual), p.radius_sigmas * F.coalesce(uncertainty, F.lit(0.0)))
    return F.least(F.greatest(wide, F.lit(p.radius_least)), F.lit(p.radius_most))


def heading_weight(speed: Column, p: Profile = PROFILE) -> Column:
    """0 up to one speed, 1 from another on, straight between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (speed - p.heading_from) / (p.heading_full - p.heading_from)))


def emission(lateral: Column, uncertainty: Column, heading: Column, tangent: Column, speed: Column, p: Profile = PROFILE) -> Column:
    """How well an arc explains an observation; without a heading its part is left out."""
    sigma = F.least(F.lit(p.sigma_most), F.hypot(F.lit(p.sigma_least), F.coalesce(uncertainty, F.lit(0.0))))
    turn = F.when(heading.isNull(), F.lit(0.0)).otherwise(heading_weight(speed, p) * gauss(wrapped(heading, tangent), F.lit(p.heading_sigma)))
    return gauss(lateral, sigma) + turn


def transition(graph: Column, observed: Column, seconds: Column, turns: Column, u_turns: Column, from_off: Column, to_off: Column, p: Profile = PROFILE) -> Column:
    """How plausible it is to go from one candidate to the next; null where there is no way, or it would be too fast."""
    speed = graph / seconds
    excess = F.greatest(F.lit(0.0), speed - observed / seconds - p.speed_allowance)
    on = -F.abs(graph - observed) / p.distance_scale - p.speed_cost * excess - p.turn_cost * turns - p.u_turn_cost * u_turns
    off = F.when(from_off & to_off, p.off_map_stay).when(from_off | to_off, p.off_map_change)
    return F.coalesce(off, F.when((seconds > 0) & (speed <= p.top_speed), on))


def rejection(graph: Column, seconds: Column, rule: Column, p: Profile = PROFILE) -> Column:
    """Why a transition is impossible: the first reason, null if it is possible."""
    return (
        F.when(seconds <= 0, "time_not_increasing")
        .when(rule == "FORBIDDEN", "forbidden_turn")
        .when(rule == "UNKNOWN_RESTRICTION", "unknown_restriction")
        .when(graph.isNull(), "no_path")
        .when(graph / seconds > p.top_speed, "too_fast")
    )
