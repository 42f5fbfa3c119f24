"""A PySpark engine for barcoded sequencing reads: parsing, barcode correction, molecule counting and the statistics after it."""
