"""Text, stemming, phonetic, distance and scoring functions."""
