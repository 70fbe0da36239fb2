"""gamelode.functions"""
