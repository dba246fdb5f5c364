"""Count-matrix analytics as DataFrame plans."""
