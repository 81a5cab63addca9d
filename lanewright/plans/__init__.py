"""From steps to frames: candidates, decisions and bodies."""
