"""The layers: ingest, cleanse, analyse, and all three in a row."""
