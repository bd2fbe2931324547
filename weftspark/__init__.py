"""weftspark: document-to-graph analytics as DataFrame programs."""
