"""Part of crowdsignal; see the README."""
