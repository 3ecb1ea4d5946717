"""tidewater: data-algorithm operators expressed as Spark DataFrame plans."""
