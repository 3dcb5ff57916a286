"""Names of the stages of a search, and the settings that each answers to."""

from __future__ import annotations

DEM = "DEM pixels"
FINITE = "finite elevation"
SLOPE = "slope"
ALTITUDE = "altitude"
ASPECT = "aspect"
ROAD = "near a road"
ZONES = "outside zones"
STRIDE = "kept by stride"
DIRECTIONS = "directions accepted"
SCORE = "score cut"
CLOSED = "after gap closing"
PRUNED = "after pruning"
SELECTED = "pixels in selected sites"

#: Stage to fields of SearchParams, the one to sweep first in front.
SETTINGS = {
    SLOPE: ("min_slope", "max_slope"), ALTITUDE: ("min_altitude", "max_altitude"), ASPECT: ("min_aspect", "max_aspect"), ROAD: ("max_road_km",),
    STRIDE: ("stride",), DIRECTIONS: ("scan",), SCORE: ("min_score", "top_percent"), CLOSED: ("gap_close_km",), PRUNED: ("min_width_km",),
    SELECTED: ("min_sub_array", "target"),
}
#: Stages that thin or widen the list of pixels but reject no ground.
NOT_A_CUT = (STRIDE, CLOSED, SELECTED)
