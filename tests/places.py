"""Where the test tables are."""

SF = "/root/testdata/sf0.001"
