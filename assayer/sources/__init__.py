"""Reading datasets, file corpora and the results of earlier runs."""
