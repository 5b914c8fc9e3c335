"""Fixed values of the domain: scores, penalties, boxes, tolerances."""

from __future__ import annotations

# candidate scores
HEMI, SYMBOL, SYMBOL_MOST, SAME_FORMAT = 3.0, 0.75, 4, 1.0
IN_ALPS, IN_FRANCE, SWAPPED, UNUSED, UTM_BASE = 4.0, 2.0, 1.5, 1.2, 6.0
ALT_GAP, ALT_METRES = 1.0, 50.0
# penalties of a reading
DD_SHORT, DD_INTEGER, NMEA, DEGREE_AS_ZERO, DMM_FIX = 1.5, 5.0, 1.0, 3.0, 0.5
# WGS84 and UTM
WGS84_A, WGS84_F, UTM_K0 = 6378137.0, 1 / 298.257223563, 0.9996
DATE_LINE_SLACK = 1e-4  # degrees: a metre at the highest latitude of UTM
# boxes: lat from, lat to, lon from, lon to
ALPS = (43.0, 48.6, 4.0, 17.0)
FRANCE = (41.0, 51.6, -5.6, 10.0)
ROUTE_FRANCE = (41.0, 51.5, -5.5, 10.0)
SPHERE_M, SIGHT_SPHERE_M = 6371008.8, 6371000.0
# tracks
MIN_DT_MS, DUP_M, DUP_MS, SAME_M = 600_000, 3.0, 60_000, 0.5
# votes
VOTE_TOLERANCE, VOTE_NEED, VOTE_MARGIN = 0.00002, 3, 2
# photos: passes over a box and over a widened one, margin around a zone, least side of a frame, tilts and lean
PASSES, WIDE_PASSES, ZONE_PAD, FRAME_LEAST = 11, 6, 0.35, 0.02
TILT_MOST, LEAN_GAIN, ZONE_LEAN = 45.0, 1.5, 0.4
# places
PLACE_RADIUS_M, ALTITUDE_PACK, RELIEF_MOVE_M, SMOOTHING = 2000.0, 100, 25.0, 0.25
HISTORY_KEPT, HISTORY_CHARS, HISTORY_DWELL_S = 10, 400, 1.5
LABEL_CHARS = 40
PIN_PX, PROFILE_PIN_PX = 26.0, 22.0
WINDS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO"]
UTM_BANDS = "CDEFGHJKLMNPQRSTUVWX"
