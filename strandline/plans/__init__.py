"""Named queries; importing this package registers them."""

from strandline.plans import q_predict, q_rd, q_scalar, q_sources, q_stream, q_tables, q_text  # noqa: F401
