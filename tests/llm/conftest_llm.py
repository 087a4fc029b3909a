"""Paths that the tests of the corpus operators share."""

SF = "/root/testdata/sf0.001"
