"""lexpack: profile, train on, and losslessly pack columns of small records with PySpark."""
