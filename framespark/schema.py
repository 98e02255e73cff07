"""Schemas of the tables that the operators take and give."""

FRAMES = "file_id int, item_idx long, frame_id long, detector string, c int, h int, w int, pixels array<float>, label array<float>"
MANIFEST = "file_id int, path string, mean double, std double"
FILE_INDEX = "file_id int, path string, n long, start long, end_excl long, error string"
PANELS = "idx int, event long, panel int, h int, w int, pixels array<float>"
PANEL_GEOM = "panel int, x_min int, y_min int, x_max int, y_max int"
