"""Part of vesselspark; see README for the layout."""
