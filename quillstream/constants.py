"""Fixed values of the symbol protocol and its thresholds."""

START, END, NONE, NUM_CLASSES = 256, 257, 258, 259
MIN_PARITY, MAX_PAYLOAD = 4, 188
CRC_POLY, CRC_INIT = 0x1021, 0xFFFF
GF_PRIM, GF_GENERATOR = 0x11D, 2
SPLIT_RUN, MIN_FRAMES_ERASURE, STATS_WINDOW, MIN_STATS = 3, 2, 21, 5
BREAK_PERIODS, MERGE_PERIODS, MIN_CONTROL_FRAMES = 6, 0.55, 2
DT_WINDOW, DT_MAX_MS, DT_DEFAULT_MS = 31, 500, 33
MAX_PASSES, MAX_PASS_LEN = 12, 262
ALIGN_MATCH, ALIGN_MISMATCH, ALIGN_GAP = 2, -1, -2
MISALIGNED_WEIGHT, MISALIGNED_TOLERANCE, OPEN_PASS_SLACK = 0.7, 4, 2
RELIABILITY_FLOOR, RELIABILITY_DEFAULT, COPY_RELIABILITY = 0.05, 0.5, 0.6
CAL_CLASSES, ANCHOR_WINDOW = 258, 24
ACCEPT_P, ACCEPT_MARGIN = 0.6, 0.3
GAP_RESIDUAL_MAX, GAP_RESIDUAL_NONE_MAX, GAP_GRID = 2.0, 10.0, 16
HISTORY_CAP = 50
#: Speeds of display in ms: (symbol, gap).
SPEEDS = {"slow": (700, 200), "normal": (500, 150), "fast": (320, 110)}
#: The sender's frame, and how a receiver finds it (fixed values): colour, ground between symbols, border and outer side as
#: shares; hue range (degrees), least saturation, least chroma; least area, ring fill, candidates, middle share.
FRAME_RGB, GAP_GRAY, FRAME_BORDER, FRAME_OUTER = (255, 0, 170), 128, 0.06, 0.92
HUE_RANGE, SATURATION_MIN, CHROMA_MIN = (280.0, 352.0), 0.35, 40
AREA_MIN, RING_FILL, CANDIDATES, MIDDLE = 0.002, (0.1, 0.45), 3, 0.8
SIDE_MIN, ASPECT_MAX, PIXELS_MIN = 12.0, 3.0, 8
#: Width of the raster that frames are worked on; they are located on one of half that width.
WORK_WIDTH = 640
