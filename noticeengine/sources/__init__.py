"""Readers and writers: day folders, rosters, workbooks, slides, and views of the driver tables."""
