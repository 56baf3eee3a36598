"""weftline: a PySpark-native analytics engine for histories, dialogues, rankings and text corpora."""
