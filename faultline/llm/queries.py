"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from . import avi, fmindex, html_crf, lines, packing, quality, ring, sigtree, sstable, tiling

QUERIES = {
    f.__name__: f
    for f in (
        sstable.op1_sstable, avi.op2_avi_mjpeg, fmindex.op3_fm_index, quality.op4_byte_cnn, tiling.op5_string_tiling,
        lines.op6_line_runs, sigtree.op7_signature_trees, packing.op8_residual_packing, html_crf.op9_crf_html, ring.op10_bounded_ring,
    )
}
ORACLES = {"op3_fm_index": fmindex.OP3_SQL, "op6_line_runs": lines.OP6_SQL, "op7_signature_trees": sigtree.OP7_SQL}
