"""Constants of the document model and page layout (fixed values)."""

SCHEMA_VERSION = "0.4"
MAX_CELLS, MAX_EXPANDED_CHARS, MAX_ASSET_BYTES = 100_000, 10_000_000, 512 << 20
# pages
SCANNED_INVISIBLE, SCANNED_COVERAGE, SCANNED_CHARS, UNRELIABLE_RATIO = 0.5, 0.15, 50, 0.1
MARGIN_ZONE, MARGIN_DRIFT, MARGIN_PAGES = 0.08, 0.02, 3
# lines
SIZE_STEP, LINE_STEP, WIDE_GAP, SPACE_GAP, PARA_GAP = 0.5, 0.5, 3.0, 0.2, 0.8
HEADING_RATIO, HEADING_BOLD_RATIO, MAX_LEVEL = 1.15, 1.05, 6
# rules
SNAP, JOIN_GAP, TOUCH = 1.5, 3.0, 2.0
# figures and model boxes
NMS_SAME, NMS_OTHER, NMS_SCORE = 0.6, 0.98, 0.2
CAPTION_GAP, CAPTION_OVERLAP = 30.0, 0.3
# OCR lines
OCR_SCORE, OCR_SHORT_SCORE, OCR_SHORT, OCR_OVERLAP = 0.5, 0.7, 2, 0.5
COLUMN_GAP, BAND_GAP, MIN_COLUMN, SAME_ROW = 2.0, 1.0, 0.25, 0.7
OCR_PARA_GAP, OCR_INDENT, OCR_HEIGHT, OCR_CONFIDENCE = 0.8, 1.0, 0.5, 0.5
CONFIDENCE = {"heading": 0.6, "paragraph": 0.7, "list_item": 0.7, "page_header": 0.8, "page_footer": 0.8, "ruled_table": 0.6, "borderless_table": 0.4, "figure": 0.7, "caption": 0.7, "unreliable": 0.2}
MAX_NESTING = 20
# text-made edges of ruled tables
EDGE_COVER, MIN_FILLED, HEADER_COVER = 0.5, 0.3, 0.9
COL_GAP, MIN_GAP_ROWS, NARROW_GAP, NARROW_ROWS = 1.0, 2, 0.2, 3
ROW_ALIGN, ROW_GAP, ROW_PITCH, CENTER_TOL, CORE, CROSS_EPS = 0.1, 0.8, 0.85, 0.1, 0.25, 0.1
LAYOUT_AREA, LAYOUT_LINES = 0.65, 6
# tables without rules
PAD, SCRIPT, SCRIPT_OVERLAP, WORD_GAP, LETTER_GAP = 1.0, 0.85, 0.3, 0.2, 1.2
GUTTER, CROSS_FRAC, MIN_SUPPORT, ALL_LINES_GAP, NEST_TOL = 0.5, 0.15, 2, 1.0, 0.5
VRULE_COVER, VRULE_INSET, BIMODAL, LEAD_TOL, LEAD_CAP = 0.5, 2.0, 1.15, 1.15, 1.6
LABEL_FULL, OVERLAP, HEAD_RULE, CMID_DROP, CMID_WIDTH, VCENTER = 0.75, 0.2, 0.6, 1.2, 0.9, 0.3
CURRENCY, CLOSERS = frozenset("$€£¥₩"), frozenset("%)")
CHUNK_GAP, MAX_VGAP, ALIGN, MIN_MULTI = 1.0, 4.5, 1.0, 2
PROSE_WIDTH, LIST_FRAC, SENTENCE_FRAC, SENTENCE_CHARS, CHART_RULES = 0.30, 0.6, 0.6, 25, 4
WIDE_CHUNK, PAGE_GUTTER_LINES, BORDERLESS_FILLED, CONTAINED, RULED_IOU, TABLE_SCORE = 0.25, 3, 0.7, 0.5, 0.5, 0.5
# figures
FIGURE_SCORE, CAPTION_SCORE, CONTAIN, INSIDE, SAME_IOU, CONFIRM_IOU, CAPTURE_PAD = 0.5, 0.4, 0.9, 0.8, 0.5, 0.5, 2.0
IMAGE_SIDE, IMAGE_AREA, BACKGROUND_GLYPHS, LAYOUT_PATHS, TABLE_RULES, RULE_WIDTH = 24.0, 0.025, 50, 10, 3, 0.3
# image models
DET_SHORT, DET_LONG, DET_PIXEL, DET_MEAN, DET_GROW, DET_SIDE, DET_ROW = 736, 4000, 0.3, 0.5, 1.6, 3, 10
REC_HEIGHT, REC_BATCH, REC_BUDGET = 48, 6, 6 * 3200
# drawn paths
DASH, MIN_RULE, THIN, AXIS_TOL, LEN_EPS, WHITE, MAX_SEGMENTS = 0.2, 2.0, 2.5, 0.5, 1e-3, 250, 200_000
