"""burncal: satellite active-fire analytics as PySpark DataFrame transformations."""
